"""Steps that must not grow with a batch, a table's files or a keyword list."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from postlake.functions import batches
from postlake.functions import variants as V
from postlake.functions.html import linked_articles
from postlake.functions.text import norm_text
from postlake.functions.xml import xml_feed
from postlake.operators.rules import GlobalFilters, contains_any, effective_rules, evaluate, with_norms
from postlake.plans import q_runs, sites
from postlake.sources import common


def _optimised(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_feeds_are_handed_on_in_small_pieces():
    feeds = pd.Series([f"<jobs><job><id>{i}</id></job></jobs>" for i in range(1000)] + [None, "<broken"])
    parts = list(xml_feed.func(iter([feeds, feeds.iloc[:0]])))
    assert max(map(len, parts)) <= batches.PIECE_TEXTS
    whole = pd.concat(parts)
    assert [r[0][0]["value"] for r in whole["records"][:1000]] == [str(i) for i in range(1000)]
    assert len(whole) == 1002 and whole["error"].notna().sum() == 2


def test_linked_pages_are_handed_on_in_small_pieces():
    long = "x" * batches.PIECE_CHARS
    pages = pd.Series([f'<article><a href="/{i}">t</a></article>' for i in range(500)] + [long, long, None])
    parts = list(linked_articles.func(iter([pages])))
    assert max(map(len, parts)) <= batches.PIECE_TEXTS and len(parts) >= 5
    whole = pd.concat(parts)
    assert [links[0]["attrs"] for links in whole["links"][:500]] == [f' href="/{i}"' for i in range(500)]
    assert [len(links) for links in whole["links"][500:]] == [0, 0, 0]


def test_a_text_is_normalised_once_for_all_keywords(spark):
    rows = spark.createDataFrame([("Ein Café",), (None,)], "t string")
    keywords = F.array(F.lit("cafe"), F.lit("--"), F.lit("tea"))
    hits = rows.select(norm_text("t").alias("n"), with_norms(keywords).alias("k")).select(contains_any("n", "k").alias("hits"))
    assert [r.hits for r in hits.collect()] == [["cafe", "--"], ["--"]]
    tests = re.findall(r"contains\((\w+ \w+)", _optimised(hits), re.IGNORECASE)
    assert tests and all(t.startswith("lambda ") for t in tests)


def test_pages_are_parsed_once_for_their_elements(spark):
    pages = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "page int, body string").select(
        "page", F.expr("filter(split(body, ' '), x -> x <> 'c')").alias("found")
    )
    rows = common.exploded(pages, "found", "a", "page")
    assert [tuple(r) for r in rows.orderBy("page", "pos").collect()] == [(1, 0, "a"), (1, 1, "b")]
    assert _optimised(rows).count("split(") == 1


def test_pages_are_built_in_as_many_tasks_as_rows_ask_for(spark, monkeypatch):
    monkeypatch.setattr(sites, "TASK_ROWS", 10)
    rows = spark.range(1000).selectExpr("id as n", "id div 80 as c", "concat('Firm ', id div 80) as company", "id div 10 % 8 as page_no", "id % 10 as pos")
    dealt = sites.spread(rows)
    assert dealt.rdd.getNumPartitions() == 100
    docs = sites.packed(dealt, F.col("n").cast("string"), ",")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert docs.count() == 100


def test_postings_of_two_batches_are_decided_once(spark, monkeypatch):
    decisions = spark.sparkContext.accumulator(0)

    def decide(key: str) -> str:
        decisions.add(1)
        return "matched"

    def decided(_spark, _sf_dir):
        rows = spark.range(6).selectExpr(
            "id as l_orderkey", "id as l_partkey", "1 as l_linenumber", "concat('k', id div 2) as dedup_key", "id as company_ord",
            *[f"'x' as {c}" for c in ["company", "title", "location", "department", "employment_type", "match_reason", "posting_url",
              "application_url", "source", "source_job_id", "description", "matched_keywords"]],
            "date'2026-07-20' as date_posted", "timestamp'2026-07-20 06:00:00' as fetched_at",
        )
        return rows.withColumn("match_status", F.udf(decide)("dedup_key"))

    monkeypatch.setattr(q_runs, "star_decided", decided)
    stored = q_runs.s17(spark, "unused").collect()
    assert sorted((r.batch, r.deduplication_key) for r in stored) == [("b0", "k0"), ("b0", "k1"), ("b0", "k2")]
    assert decisions.value <= 12


def test_texts_are_normalised_after_the_rules_join(spark):
    """Normal forms are not shuffled, and a filter on the decisions holds no copies of them."""
    fields = ["company", "title", "description", "department", "location", "employment_type"]
    rows = [("Acme", "Big  Gizmo", None, "R&D", "Berlin", ""), ("Acme", "Old Gizmo", "x", None, "Paris", "Full")]
    postings = spark.createDataFrame([(*r, 1) for r in rows], ", ".join(f"{f} string" for f in fields) + ", company_ord long")
    filters = GlobalFilters(title_keywords=["gizmo"], exclude_keywords=[], locations=["berlin", "paris"], seniority_exclude=["old"])
    none = [F.array().cast("array<string>").alias(n) for n in ("title_keywords_include", "title_keywords_exclude", "description_keywords_include", "location_filters", "employment_types")]
    companies = postings.select("company", "company_ord", *none).distinct()
    rules = effective_rules(companies, filters)
    rules = spark.createDataFrame(rules.collect(), rules.schema)
    matched = evaluate(postings, rules).where("match_status = 'matched'")
    assert [(r.title, r.matched_keywords, r.reason_class) for r in matched.collect()] == [("Big  Gizmo", ["gizmo"], "matched")]
    above, below = _optimised(matched).split("Join Inner")
    assert "lower(" not in below
    assert above.count("lower(") == 5


def test_values_are_tested_without_writing_them_as_json(spark):
    """Objects are told from other values, and missing ones from present ones, as their JSON would tell."""
    blank = ["null", '""', "0", "0.0", "false", "[]", "{}"]
    values = [*blank, '{"a":"b"}', "[{}]", "1", "-1.5", "true", '"0"', '"0.0"', '"00000000"', '"false"', '"null"', '"{}"', '"{"', '"      "', '"a longer text"', "0.000000001", "123456789"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, j string").select("i", "j", F.try_parse_json("j").alias("v"))
    got = rows.select("j", V.is_object("v").alias("object"), V.scalar("v").alias("text"), F.expr("try_variant_get(v, '$', 'string')").alias("whole"))
    for r in got.collect():
        assert r.object == (r.j is not None and r.j.startswith("{"))
        assert r.text == (None if r.j is None or r.j in blank else r.whole)
    assert "to_json" not in str(V.is_object("v")) and "to_json" not in str(V.objects("v"))
    told = V.text_sql("v", "id")
    assert told.index("length(") < told.index("to_json(")


def test_plain_texts_are_normalised_without_a_search_for_other_characters(spark):
    rows = spark.createDataFrame([(1, b"A_b-C 9\x7f"), (2, "Caf\u00e9 \ufb01".encode()), (3, b"a\x80b"), (4, b"")], "i int, b binary")
    texts = rows.select("i", norm_text(F.col("b").cast("string")).alias("n"))
    assert [r.n for r in texts.orderBy("i").collect()] == ["a b c 9", "cafe fi", "ab", ""]
    plan = _optimised(rows.select(F.col("b").cast("string").alias("t")).select(norm_text("t")))
    assert "octet_length" in plan and "is_valid_utf8" in plan.lower()
