"""Whole runs: seen keys, isolation, replay, batch against stream, hot keys."""

from __future__ import annotations

from helpers import capture, captures, rule, rules
from pyspark.sql import functions as F

from postlake.operators.assemble import first_wins
from postlake.operators.report import COUNTS, company_counts, run_summary
from postlake.operators.rules import GlobalFilters
from postlake.operators.store import JobStore, run_log_rows
from postlake.plans.pipeline import run, run_into
from postlake.schema import RUN_LOG
from postlake.session import new_scratch
from postlake.sources.captures import failed_fetches, read_captures, write_captures
from postlake.streaming.incremental import run_incremental

FILTERS = GlobalFilters(title_keywords=["engineer"], locations=["Oslo"], seniority_exclude=[], exclude_keywords=["chef"])


def board(company, *ids, run_id="r1", title="Engineer"):
    jobs = [{"id": i, "title": title, "location": {"name": "Oslo"}} for i in ids]
    return capture("greenhouse", {"jobs": jobs}, company=company, run_id=run_id)


def two_companies(spark):
    return rules(spark, rule("greenhouse", company="A", ord_=0), rule("greenhouse", company="B", ord_=1), rule("custom", company="C", ord_=2))


def test_counts_and_failures(spark):
    seen = spark.createDataFrame([("source:a:1",)], "dedup_key string")
    done = run(captures(spark, board("A", 1, 2, 2), board("B", 1)), two_companies(spark), FILTERS, seen)
    got = {r.company: (r.jobs_fetched, r.jobs_matched, r.new_jobs_inserted, r.duplicates_skipped, list(r.failures)) for r in done.results.collect()}
    assert got == {"A": (3, 3, 1, 2, []), "B": (1, 1, 1, 0, []), "C": (0, 0, 0, 0, ["C: NotImplementedError: custom is not supported"])}
    total = done.summary.first()
    assert (total.companies_checked, total.jobs_fetched, total.new_jobs_inserted, total.duplicates_skipped) == (3, 4, 2, 2)
    assert sorted(r.dedup_key for r in done.new_jobs.collect()) == ["source:a:2", "source:b:1"]


def test_strict_mode_fails_the_company(spark):
    rows = captures(spark, board("A", 1), board("B", 1), capture("greenhouse", {"jobs": [{"id": 9, "title": "  "}]}, company="B"))
    lenient, strict = run(rows, two_companies(spark), FILTERS), run(rows, two_companies(spark), FILTERS, strict=True)
    assert {r.company: r.jobs_fetched for r in lenient.results.collect()} == {"A": 1, "B": 1, "C": 0}
    got = {r.company: (r.jobs_fetched, len(r.failures)) for r in strict.results.collect()}
    assert got == {"A": (1, 0), "B": (0, 1), "C": (0, 1)}


def test_company_choice(spark):
    done = run(captures(spark, board("A", 1), board("B", 1)), two_companies(spark), FILTERS, company="b")
    assert [r.company for r in done.results.collect()] == ["B"]
    assert done.new_jobs.count() == 1


def test_replay_adds_nothing(spark):
    store = JobStore(spark, new_scratch(spark, "replay"))
    rows = captures(spark, board("A", 1, 2), board("B", 3))
    for batch in ["b0", "b0", "b1"]:
        run_into(store, rows, two_companies(spark), FILTERS, batch=batch)
    jobs = store.jobs().collect()
    assert len(jobs) == 3 and {j.batch for j in jobs} == {"b0"}
    log = {r.batch: (r.new_jobs_inserted, r.duplicates_skipped, r.failures) for r in store.run_log().collect()}
    assert log["b0"][:2] == (3, 0) and log["b1"][:2] == (0, 3)
    assert log["b0"][2] == 1
    text = "C: NotImplementedError: custom is not supported"
    assert sorted((r.batch, r.company, r.message) for r in store.failures().collect()) == [(b, "C", text) for b in ("b0", "b1")]


def test_stream_equals_batch(spark):
    parts = [[board("A", 1, 2), board("B", 1)], [board("A", 2, 3, run_id="r2")], [board("B", 1, 4, run_id="r3"), board("A", 5, run_id="r3")]]
    base = new_scratch(spark, "stream")
    store = JobStore(spark, f"{base}/store")
    for part in parts:
        captures(spark, *part).write.mode("append").parquet(f"{base}/landing")
        run_incremental(spark, f"{base}/landing", store, two_companies(spark), f"{base}/checkpoint", FILTERS)
    run_incremental(spark, f"{base}/landing", store, two_companies(spark), f"{base}/checkpoint", FILTERS)
    whole = run(captures(spark, *[c for part in parts for c in part]), two_companies(spark), FILTERS)
    streamed = sorted(r.deduplication_key for r in store.jobs().collect())
    assert streamed == sorted(r.dedup_key for r in whole.new_jobs.collect())
    assert store.run_log().count() == 3


def test_failed_fetch_is_a_failure_of_its_company(spark):
    good = captures(spark, board("A", 1), board("B", 2))
    bad = captures(spark, capture("greenhouse", "", company="B", page_no=2, url="https://b/2", status=503), capture("greenhouse", "", company="B", page_no=1, url="https://b/1", status=404))
    lenient = run(good, two_companies(spark), FILTERS, failed=bad)
    got = {r.company: (r.jobs_fetched, list(r.failures)) for r in lenient.results.collect()}
    assert got["A"] == (1, []) and got["B"] == (1, ["B: HTTPStatusError: 404 for https://b/1"])
    strict = run(good, two_companies(spark), FILTERS, failed=bad, strict=True)
    assert {r.company: r.jobs_fetched for r in strict.results.collect()} == {"A": 1, "B": 0, "C": 0}
    assert strict.summary.first().failures == 2
    assert sorted(r.message for r in strict.failures.collect()) == ["B: HTTPStatusError: 404 for https://b/1", "C: NotImplementedError: custom is not supported"]


def test_landing_keeps_failed_fetches_apart(spark):
    base = new_scratch(spark, "landing")
    write_captures(captures(spark, board("A", 1), capture("lever", "[]", status=503)), base)
    assert read_captures(spark, base).count() == 1
    assert [r.source_type for r in failed_fetches(spark, base).collect()] == ["lever"]


def test_hot_keys_stay_exact_and_are_cut_before_the_exchange(spark):
    """A third of all rows share one key."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("dedup_key"),
        (30_000 - F.col("id")).alias("ord"), F.col("id"),
    )
    first = first_wins(rows, ["dedup_key"], ["ord"])
    brute = rows.groupBy("dedup_key").agg(F.max("id").alias("id"))
    assert {(r.dedup_key, r.id) for r in first.collect()} == {(r.dedup_key, r.id) for r in brute.collect()}
    plan = first._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[exchange:]


def test_counts_against_brute_force(spark):
    import random

    rng = random.Random(11)
    data = [("r1", f"c{c}", c, 0, i, f"k{rng.randrange(40)}", rng.choice(["matched", "filtered_out"])) for c in range(6) for i in range(60)]
    seen_keys = {f"k{i}" for i in range(0, 40, 5)}
    decided = spark.createDataFrame(data, "run_id string, company string, company_ord long, page_no int, pos int, dedup_key string, match_status string")
    seen = spark.createDataFrame([(k,) for k in sorted(seen_keys) * 2], "dedup_key string")
    known, expected = set(seen_keys), {}
    for _, company, _, _, _, key, status in data:
        row = expected.setdefault(company, [0, 0, 0, 0])
        row[0] += 1
        if status == "matched":
            row[1] += 1
            row[3 if key in known else 2] += 1
            known.add(key)
    got = {r.company: [r.jobs_fetched, r.jobs_matched, r.new_jobs_inserted, r.duplicates_skipped] for r in company_counts(decided, seen).collect()}
    assert got == expected


def test_retry_without_matches_leaves_nothing(spark):
    store = JobStore(spark, new_scratch(spark, "retry"))
    for title in ("Engineer", "Cook"):
        run_into(store, captures(spark, board("A", 1, title=title)), two_companies(spark), FILTERS, batch="a b/1")
    assert store.jobs().count() == 0
    assert [(r.batch, r.jobs_matched) for r in store.run_log().collect()] == [("a b/1", 0)]


def test_new_checkpoint_keeps_stored_jobs(spark):
    base = new_scratch(spark, "checkpoints")
    store = JobStore(spark, f"{base}/store")
    for i in (1, 2):
        captures(spark, board("A", i)).write.parquet(f"{base}/landing{i}")
        run_incremental(spark, f"{base}/landing{i}", store, two_companies(spark), f"{base}/checkpoint{i}", FILTERS)
    assert sorted(r.deduplication_key for r in store.jobs().collect()) == ["source:a:1", "source:a:2"]


def test_spaced_names_and_two_sources(spark):
    both = rules(spark, rule("greenhouse", company=" A ", ord_=0), rule("lever", company="A", ord_=1))
    done = run(captures(spark, board("A ", 1)), both, FILTERS)
    got = {r.company_ord: (r.company, r.jobs_fetched, r.new_jobs_inserted) for r in done.results.collect()}
    assert got == {0: ("A", 1, 1), 1: ("A", 0, 0)} and done.decided.count() == 1


def test_unreadable_and_rejected_are_reported(spark):
    rows = captures(
        spark, capture("greenhouse", "<html>502</html>", company="A", url="https://a/0"),
        capture("greenhouse", {"jobs": [{"id": 9, "title": "  "}, {"id": 8, "title": " "}]}, company="B"),
    )
    got = {r.company: list(r.failures) for r in run(rows, two_companies(spark), FILTERS).results.collect()}
    assert got["A"] == ["A: JSONDecodeError: 1 unreadable, first https://a/0"]
    assert got["B"] == ["B: ValidationError: title cannot be empty (2)"]


def test_funnel_credits_the_stored_row(spark):
    link = lambda c: capture("lever", [{"text": "Engineer", "hostedUrl": "https://x/1", "categories": {"location": "Oslo"}}], company=c, run_id="r1" if c == "B" else "r2")
    both = rules(spark, rule("lever", company="A", ord_=0), rule("lever", company="B", ord_=1))
    done = run(captures(spark, link("A"), link("B")), both, FILTERS)
    assert [r.company for r in done.new_jobs.collect()] == ["B"]
    assert {r.company: r.new_jobs_inserted for r in done.results.collect()} == {"A": 0, "B": 1}


def test_two_boards_of_one_name(spark):
    """One company name, two boards of one type: every posting once, each counted for its board."""
    both = rules(spark, rule("greenhouse", company="A", ats_identifier="one", ord_=0), rule("greenhouse", company="A", ats_identifier="two", ord_=1))
    job = lambda i: {"jobs": [{"id": i, "title": "Engineer", "location": {"name": "Oslo"}}]}
    rows = captures(
        spark, capture("greenhouse", job(1), company="A", board="one"), capture("greenhouse", job(2), company="A", board="two"),
        capture("greenhouse", job(3), company="A"), capture("greenhouse", "<html>", company="A", board="two", url="https://a/two", page_no=1),
        capture("greenhouse", job(4), company="A", board="of nobody"),
    )
    done = run(rows, both, FILTERS)
    assert {r.company_ord: (r.jobs_fetched, r.new_jobs_inserted, list(r.failures)) for r in done.results.collect()} == {
        0: (2, 2, []), 1: (1, 1, ["A: JSONDecodeError: 1 unreadable, first https://a/two"])}
    assert sorted(r.dedup_key for r in done.new_jobs.collect()) == ["source:a:1", "source:a:2", "source:a:3"]


def test_details_of_two_boards(spark):
    both = rules(spark, rule("icims", company="A", careers_url="https://one", ord_=0), rule("icims", company="A", careers_url="https://two", ord_=1))
    anchor = '<a href="https://x/jobs/7/role/job">Engineer</a>'
    page = lambda town: f'<script type="application/ld+json">{{"@type": "JobPosting", "jobLocation": {{"address": {{"addressLocality": "{town}"}}}}}}</script>'
    key = "https://x/jobs/7/role/job"
    rows = captures(spark, *[
        c for board, town in (("https://one", "Oslo"), ("https://two", "Bern"))
        for c in (capture("icims", anchor, company="A", board=board, page_no=0), capture("icims", page(town), company="A", board=board, kind="detail", detail_key=key))
    ])
    assert sorted((r.company_ord, r.location) for r in run(rows, both, FILTERS).postings.collect()) == [(0, "Oslo"), (1, "Bern")]


def test_broken_feed_is_a_failure(spark):
    sites = rules(spark, rule("successfactors", company="S", ord_=0))
    whole = "<jobs><job><title>Engineer</title><id>1</id><location>Oslo</location></job></jobs>"
    rows = captures(spark, capture("successfactors", whole, company="S"), capture("successfactors", whole[:40], company="S", page_no=1, url="https://s/1"))
    (row,) = run(rows, sites, FILTERS).results.collect()
    assert (row.jobs_fetched, row.new_jobs_inserted, list(row.failures)) == (1, 1, ["S: ParseError: 1 unreadable, first https://s/1"])


def test_run_log_holds_the_failure_texts(spark):
    """One per line, in company order; a company's own are sorted. Every batch has those of its run only."""
    sites = rules(
        spark, rule("custom", company="J", ord_=10), rule("greenhouse", company="A", ord_=0),
        rule("custom", company="K", ord_=9), rule("greenhouse", company="B", ord_=2),
    )
    good = captures(spark, board("A", 1), board("B", 2), capture("greenhouse", {"jobs": [{"id": 9, "title": " "}]}, company="B", page_no=1))
    bad = captures(spark, capture("greenhouse", "", company="B", page_no=2, url="https://b/2", status=503))
    store = JobStore(spark, new_scratch(spark, "texts"))
    done = run_into(store, good, sites, FILTERS, batch="b0", failed=bad)
    run_into(store, captures(spark, board("A", 1)), rules(spark, rule("greenhouse", company="A")), FILTERS, batch="b1")
    texts = done.summary.first().failure_texts.split("\n")
    assert [t.split(": ")[:2] for t in texts] == [
        ["B", "HTTPStatusError"], ["B", "ValidationError"], ["K", "NotImplementedError"], ["J", "NotImplementedError"]
    ]
    assert sorted(texts) == sorted(r.message for r in store.failures().where("batch = 'b0'").collect())
    rows = run_log_rows(store.run_log()).collect()
    assert sorted((r.companies_checked, r.failures) for r in rows) == [(1, ""), (4, "\n".join(texts))]
    assert [len(r) for r in rows] == [8, 8]
    assert {r.batch: (r.failures, r.failure_texts) for r in store.run_log().collect()} == {"b0": (4, "\n".join(texts)), "b1": (0, "")}


def test_failure_texts_of_many_companies_keep_their_order(spark):
    """Blocks of companies are joined in the order of their numbers; companies without a number come first."""
    import random

    ords = [None, *range(-1500, 2600, 3), 10**12]
    data = [(f"c{o}", o, *[1] * len(COUNTS), sorted(f"c{o}: {k}" for k in range((o or 1) % 4))) for o in ords]
    expected = [m for *_, messages in data for m in messages]
    random.Random(5).shuffle(data)
    results = spark.createDataFrame(data, f"company string, company_ord long, {', '.join(f'{c} long' for c in COUNTS)}, failures array<string>")
    total = run_summary(results.repartition(7)).first()
    assert total.failure_texts.split("\n") == expected and total.failures == len(expected) > 1024
    assert (total.companies_checked, total.jobs_fetched) == (len(ords), len(ords))
    assert tuple(run_summary(results.limit(0)).first()) == (0, 0, 0, 0, 0, 0, "")


def test_run_logs_stored_without_texts_are_still_read(spark):
    base = new_scratch(spark, "older")
    older = JobStore(spark, base)
    older.tables["run_log"] = type(RUN_LOG)([f for f in RUN_LOG if f.name != "failure_texts"])
    run_into(older, captures(spark, board("A", 1)), two_companies(spark), FILTERS, batch="b0")
    run_into(JobStore(spark, base), captures(spark, board("A", 2)), two_companies(spark), FILTERS, batch="b1")
    log = {r.batch: (r.failures, r.failure_texts) for r in JobStore(spark, base).run_log().collect()}
    assert log == {"b0": (1, None), "b1": (1, "C: NotImplementedError: custom is not supported")}
