"""Parsers on small captures: aliases, fallbacks, odd payloads."""

from __future__ import annotations

import json
from datetime import date

from helpers import capture, captures, detail, rule, rules

from pyspark.sql import functions as F

from postlake.functions import html as H
from postlake.functions import variants as V
from postlake.operators import assemble
from postlake.operators.assemble import drop_requisition_repeats, page_report
from postlake.sources import parse_all
from postlake.sources.ashby import parse_ashby
from postlake.sources.avature import parse_avature
from postlake.sources.eightfold import parse_eightfold
from postlake.sources.greenhouse import parse_greenhouse
from postlake.sources.icims import parse_icims
from postlake.sources.lever import parse_lever
from postlake.sources.smartrecruiters import parse_smartrecruiters
from postlake.sources.successfactors import parse_successfactors
from postlake.sources.workday import parse_workday


def parse(spark, parser, rows, rule_row, **kw):
    out = parser(captures(spark, *rows), rules(spark, rule_row), **kw).collect()
    return sorted(out, key=lambda r: (r.page_no, r.pos))


def test_greenhouse_falsy_values_and_odd_elements(spark):
    body = {"jobs": [{"id": 0, "title": "", "location": "text", "departments": [], "metadata": [1], "content": None, "updated_at": "x"}, "str", None,
                     {"id": "a1", "title": "T", "location": {"name": "L"}, "departments": [{"name": "D"}], "absolute_url": "https://u", "updated_at": "2026-07-18T01:02:03Z"}]}
    first, second = parse(spark, parse_greenhouse, [capture("greenhouse", body)], rule("greenhouse"))
    assert (first.title, first.location, first.source_job_id, first.employment_type, first.date_posted) == ("Untitled role", None, None, None, None)
    assert (second.pos, second.department, second.posting_url, second.date_posted) == (3, "D", "https://u", date(2026, 7, 18))


def test_unreadable_and_disabled_give_nothing(spark):
    assert parse(spark, parse_greenhouse, [capture("greenhouse", "{oops")], rule("greenhouse")) == []
    assert parse(spark, parse_greenhouse, [capture("greenhouse", {"jobs": [{"id": 1}]})], rule("greenhouse", enabled=False)) == []


def test_lever_shapes(spark):
    row = {"id": "x", "text": "T", "hosted_url": "https://h", "lists": [{"content": "c"}, 3], "createdAt": 1784332800000, "categories": None}
    (only,) = parse(spark, parse_lever, [capture("lever", {"postings": [row]})], rule("lever"))
    assert (only.description, only.application_url, only.location, only.date_posted) == ("c", "https://h", None, date(2026, 7, 18))
    (bare,) = parse(spark, parse_lever, [capture("lever", [{"id": "y"}])], rule("lever"))
    assert (bare.title, bare.description) == ("Untitled role", "")


def test_ashby_text_or_object(spark):
    body = {"jobs": [{"id": "1"}, {"id": "2", "location": "Rome", "department": {"name": "D"}}, {"id": "3", "location": {"name": "Oslo"}, "department": ""}]}
    rows = parse(spark, parse_ashby, [capture("ashby", body)], rule("ashby"))
    assert [(r.title, r.location, r.department) for r in rows] == [("Untitled role", None, None), ("Untitled role", "Rome", "D"), ("Untitled role", "Oslo", None)]


def test_workday_relative_date_uses_fetch_day(spark):
    body = {"total": 2, "jobPostings": [
        {"title": "A", "externalPath": "/job/1", "bulletFields": ["JR1"], "postedOn": "Posted 3 Days Ago", "jobPostingInfo": {"jobDescriptionFields": ["x", {"label": "Employment", "text": "Full"}]}},
        {"title": "B", "bulletFields": [], "id": 7, "jobPostingInfo": {"externalUrl": "https://e/x"}}]}
    a, b = parse(spark, parse_workday, [capture("workday", body)], rule("workday", careers_url="https://w.example.com/Ext/"))
    assert (a.posting_url, a.employment_type, a.date_posted, a.source_job_id) == ("https://w.example.com/Ext/job/1", "Full", date(2026, 7, 17), "JR1")
    assert (b.posting_url, b.source_job_id) == ("https://e/x", "7")


def test_smartrecruiters_overlay_by_presence(spark):
    listed = {"totalFound": 2, "content": [{"id": "1", "name": "Eng (x)", "ref": "https://d/1", "department": {"label": "L"}, "description": "list"}, {"id": "2", "name": "Two"}]}
    rows = parse(
        spark, parse_smartrecruiters,
        [capture("smartrecruiters", listed, url="https://api/p?limit=1"), detail("smartrecruiters", "https://d/1", {"department": None, "function": "F", "jobAd": {"jobDescription": "a &amp; b"}})],
        rule("smartrecruiters", ats_identifier="Co"),
    )
    assert [(r.department, r.description, r.posting_url) for r in rows] == [
        ("F", "a & b", "https://jobs.smartrecruiters.com/Co/1-eng-x"), (None, None, "https://jobs.smartrecruiters.com/Co/2-two")]


def test_eightfold_reads_pages_beyond_the_count(spark):
    page = lambda i, n: capture("eightfold", {"data": {"count": 3, "positions": [{"id": i * 10 + k, "name": "N"} for k in range(n)]}}, page_no=i)
    rows = parse(spark, parse_eightfold, [page(1, 2), page(2, 2), page(3, 2)], rule("eightfold", ats_identifier="d.com"))
    assert [r.source_job_id for r in rows] == ["10", "11", "20", "21", "30", "31"]


def test_icims_duplicates_and_fallbacks(spark):
    search = '<a href="/jobs/1/a/job" title="One">x</a><a href="/jobs/1/b/job">dup</a><a href="/jobs/2/c/job"></a><a href="/jobs/3/d/login">no</a><a href="/jobs/4/e/job"> Four&nbsp;4 </a>'
    rows = parse(spark, parse_icims, [capture("icims", search, url="https://c.example.com/jobs/search?pr=0")], rule("icims"))
    assert [(r.source_job_id, r.title, r.posting_url) for r in rows] == [("1", "One", "https://c.example.com/jobs/1/a/job"), ("4", "Four 4", "https://c.example.com/jobs/4/e/job")]


def test_json_ld_at_any_depth(spark):
    inner = json.dumps({"@type": ["Thing", "JobPosting"], "title": "Deep"})
    body = f'<script type="application/ld+json">{"[1, " * 12}{{"@graph": [{inner}, {{"@type": "JobPosting", "title": "Later"}}]}}{"]" * 12}</script>'
    found = spark.createDataFrame([(body,), ("<p>none</p>",)], "body string").select(V.text(H.json_ld_posting("body"), "title").alias("t"))
    assert [r.t for r in found.collect()] == ["Deep", None]


def test_avature_keeps_summary_without_detail(spark):
    search = ('<article><a href="/careers/JobDetail/X/11">A</a><div class="article__content">S</div><p><i class="icon-tag"></i>T</p><p><i class="icon-address"></i>P</p></article>'
              '<a href="/careers/FolderDetail/Y/12/">B</a>')
    rows = parse(spark, parse_avature, [capture("avature", search, url="https://a.example.com/careers/SearchJobs")], rule("avature"))
    assert [(r.source_job_id, r.title, r.location, r.department, r.description) for r in rows] == [("11", "A", "P", "T", "S"), ("12", "B", None, None, None)]


def test_successfactors_sniffs_both_formats(spark):
    feed = '<jobs><job><referencenumber>007</referencenumber></job></jobs>'
    board = '<tr class="data-row"><td><a class="jobTitle-link" href="/job/x/9/">T</a></td><td class="colLocation">Here</td></tr>'
    (xml,) = parse(spark, parse_successfactors, [capture("successfactors", feed)], rule("successfactors"))
    assert (xml.title, xml.source_job_id, xml.location, xml.description) == ("Untitled role", "007", None, None)
    (html,) = parse(spark, parse_successfactors, [capture("successfactors", board)], rule("successfactors"))
    assert (html.title, html.source_job_id, html.location) == ("T", "9", "Here")


def test_requisition_chains_follow_page_order(spark):
    """b is skipped because of a; c is kept because the posting that claims it was skipped."""
    data = [("r", "A", 0, 0, "1", "2"), ("r", "A", 0, 1, "2", "3"), ("r", "A", 0, 2, "3", "R"), ("r", "A", 1, 0, "4", "R"), ("r", "A", 1, 1, "5", "1"),
            ("r", "B", 0, 0, "2", None), ("r", "A", 2, 0, "R", None)]
    rows = spark.createDataFrame(data, "run_id string, company string, page_no int, pos int, u string, q string")
    kept = {(r.company, r.u) for r in drop_requisition_repeats(rows, "u", "q").collect()}
    seen, expected = {}, set()
    for _, company, _, _, u, q in sorted(data, key=lambda r: r[1:4]):
        taken = seen.setdefault(company, set())
        if u not in taken:
            taken.update({u, q or u})
            expected.add((company, u))
    assert kept == expected and ("A", "3") in kept and ("A", "2") not in kept


def test_page_report_against_a_loop(spark, monkeypatch):
    import random

    monkeypatch.setattr(assemble, "BLOCK_PAGES", 3)
    rng = random.Random(3)
    data = [(f"c{c}", p, rng.choice([5, 5, 5, 4]), rng.choice([None, 12, 100])) for c in range(40) for p in range(8)]
    df = spark.createDataFrame(data, "company string, page_no int, n_objects int, total int")
    got = {(r.company, r.page_no): (r.so_far, r.stop) for r in page_report(df, 5, keys=["company"]).collect()}
    expected = {}
    for company in {d[0] for d in data}:
        so_far = 0
        for _, page_no, n, total in sorted((d for d in data if d[0] == company), key=lambda d: d[1]):
            so_far += n
            expected[company, page_no] = (so_far, so_far >= (so_far if total is None else total) or n < 5)
    assert got == expected


def test_every_landed_page_is_parsed(spark):
    pages = [capture("workday", {"total": 40, "jobPostings": [{"title": "T", "id": f"{p}-{k}"} for k in range(20)]}, page_no=p) for p in range(30)]
    assert len(parse(spark, parse_workday, pages, rule("workday", extra={"max_pages": "2"}))) == 600


def test_long_claim_chain(spark):
    """Every posting is claimed by the one before it: every second one goes."""
    rows = spark.range(20_000).select(
        F.lit("r").alias("run_id"), F.lit("A").alias("company"), F.floor(F.col("id") / 50).cast("int").alias("page_no"),
        (F.col("id") % 50).cast("int").alias("pos"), F.col("id").cast("string").alias("u"), (F.col("id") + 1).cast("string").alias("q"),
    )
    kept = drop_requisition_repeats(rows, "u", "q").agg(F.count("*").alias("n"), F.max(F.col("u").cast("int") % 2).alias("odd")).first()
    assert (kept.n, kept.odd) == (10_000, 0)


def test_claim_trees_against_a_loop(spark):
    import random

    rng = random.Random(9)
    for size in (12, 60):
        ids = list(range(size))
        data = [("r", c, i // 5, i % 5, str(i), rng.choice([None, *map(str, ids[max(0, i - 3) : i + 6])])) for c in "AB" for i in ids]
        df = spark.createDataFrame(data, "run_id string, company string, page_no int, pos int, u string, q string")
        kept = {(r.company, r.u) for r in drop_requisition_repeats(df, "u", "q").collect()}
        expected = set()
        for c in "AB":
            taken = set()
            for _, _, _, _, u, q in sorted((d for d in data if d[1] == c), key=lambda d: d[2:4]):
                if u not in taken:
                    expected.add((c, u))
                    if q is not None and q != u:
                        taken.add(q)
        assert kept == expected


def test_one_name_with_two_sources(spark):
    both = rules(spark, rule("greenhouse", ord_=0), rule("lever", ord_=1))
    rows = captures(spark, capture("greenhouse", {"jobs": [{"id": 1, "title": "T"}]}), capture("lever", [{"id": "x", "text": "U"}]))
    got = parse_all(rows, both).collect()
    assert sorted((r.source, r.company_ord, r.title) for r in got) == [("greenhouse", 0, "T"), ("lever", 1, "U")]
