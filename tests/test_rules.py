"""The decision ladder branch by branch, keys, and configuration checks."""

from __future__ import annotations

import pytest
from helpers import rule, rules
from pyspark.sql import functions as F

from postlake.operators.dedup import with_dedup_key
from postlake.operators.rules import (
    GlobalFilters,
    check_rules,
    effective_rules,
    evaluate,
    require_company,
    select_companies,
)

FIELDS = "company string, company_ord long, title string, description string, department string, location string, employment_type string, source_job_id string, application_url string, posting_url string"


def decide(spark, rule_row, filters=None, **fields):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    row = {"company": "Acme", "company_ord": 0, "title": "Machine Learning Engineer", "location": "Austin, TX", **fields}
    df = spark.createDataFrame([tuple(row.get(n) for n in names)], FIELDS)
    effective = effective_rules(rules(spark, rule_row), filters or GlobalFilters())
    return evaluate(df, effective).first()


AUSTIN = dict(location_filters=["Austin"])


def test_match_and_reason(spark):
    r = decide(spark, rule("lever", **AUSTIN), description="LLM agents")
    assert r.match_status == "matched"
    assert r.matched_keywords == ["machine learning", "llm", "agents"]
    assert r.match_reason == "title matched: machine learning; description matched: llm, agents; location matched: Austin"


@pytest.mark.parametrize(
    ("rule_fields", "fields", "reason"),
    [
        (AUSTIN, {"description": "works with internal tools"}, "excluded keyword(s): intern"),
        (AUSTIN, {"title": "Director, Machine Learning"}, "excluded seniority: director"),
        (AUSTIN, {"location": "Paris"}, "location did not match configured filters: Paris"),
        (AUSTIN, {"location": None}, "location did not match configured filters: "),
        ({}, {"location": "Remote, United States"}, "location did not match configured filters: Remote, United States"),
        ({**AUSTIN, "employment_types": ["full time"]}, {"employment_type": "Contract"}, "employment type did not match: Contract"),
        (AUSTIN, {"title": "Chef"}, "no configured title or description keywords matched"),
    ],
)
def test_rejections(spark, rule_fields, fields, reason):
    r = decide(spark, rule("lever", **rule_fields), **fields)
    assert (r.match_status, r.match_reason, r.matched_keywords) == ("filtered_out", reason, [])


def test_employment_filter_needs_a_value(spark):
    assert decide(spark, rule("lever", **AUSTIN, employment_types=["full time"])).match_status == "matched"


def test_internships_can_be_allowed(spark):
    filters = GlobalFilters(allow_internships=True)
    assert decide(spark, rule("lever", **AUSTIN), filters, title="Machine Learning Intern").match_status == "matched"
    assert decide(spark, rule("lever", **AUSTIN), title="Machine Learning Intern").match_status == "filtered_out"


def test_blank_keyword_matches_everything(spark):
    r = decide(spark, rule("lever", **AUSTIN, title_keywords_include=["—", " chef "]), title="Driver")
    assert r.matched_keywords == ["—"]


def test_key_cascade(spark):
    rows = [
        ("Éxample", 0, "T", None, None, None, None, "ABC-123", "https://a/1", None),
        ("Example", 0, "T", None, None, None, None, "", "https://A/1/?utm_x=1", "https://p"),
        ("Example", 0, "T", None, None, None, None, None, None, "https://a/1"),
        ("Example", 0, "Sr. SWE", None, None, "U.S.", None, None, "", None),
    ]
    keys = [r.dedup_key for r in with_dedup_key(spark.createDataFrame(rows, FIELDS)).collect()]
    assert keys[0] == "source:example:abc 123"
    assert keys[1] == keys[2] and keys[1].startswith("url:") and len(keys[1]) == 20
    assert keys[3] == "fallback:example:senior software engineer:us"


def test_select_companies(spark):
    table = rules(spark, rule("lever", company="Big Co", ord_=0), rule("lever", company="Other", slug="oth", ord_=1), rule("lever", company="Off", enabled=False, ord_=2))
    assert {r.company for r in select_companies(table).collect()} == {"Big Co", "Other"}
    for key in ["BIG-CO", "big co"]:
        assert [r.company for r in select_companies(table, key).collect()] == ["Big Co"]
    assert [r.company for r in select_companies(table, "OTH").collect()] == ["Other"]
    with pytest.raises(ValueError, match="no enabled company"):
        require_company(table, "off")


def test_check_rules(spark):
    table = rules(spark, rule("lever", ats_identifier="x"), rule("custom", company=" ", ord_=1), rule("nope", company="C", ord_=2), rule("icims", company="D", ord_=3))
    assert {(r.company_ord, r.breach) for r in check_rules(table).collect()} == {
        (1, "company name is required"), (2, "unknown source type"), (3, "a locator is required")}
    assert [r.breach for r in check_rules(table.where(F.lit(False))).collect()] == ["at least one company must be configured"]
