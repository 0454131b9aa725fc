"""Versions of the store, key tables, sightings, and captures that wait for their run's end."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from helpers import capture, captures, detail, rule, rules
from pyspark.sql import functions as F

from postlake.operators import keytable
from postlake.operators.keytable import KeyTable
from postlake.operators.manifest import KEPT, Manifest
from postlake.operators.rules import GlobalFilters
from postlake.operators.store import JobStore
from postlake.plans.pipeline import run, run_into
from postlake.schema import KEYS
from postlake.session import new_scratch
from postlake.streaming.incremental import END, PendingCaptures, SightingsTable, keep_sightings, run_incremental

FILTERS = GlobalFilters(title_keywords=["engineer"], locations=["Oslo"], seniority_exclude=[], exclude_keywords=[])


def board(*ids, run_id="r1"):
    return capture("greenhouse", {"jobs": [{"id": i, "title": "Engineer", "location": {"name": "Oslo"}} for i in ids]}, run_id=run_id)


def test_versions_never_replace_each_other(spark):
    base = new_scratch(spark, "versions")
    one, two = Manifest(spark, base), Manifest(spark, base)
    assert one.read() == (0, {})
    calls = []

    def slow(state):
        if not calls:
            two.commit(lambda s: {**s, "b": 2})  # another writer comes first
        calls.append(dict(state))
        return {**state, "a": len(calls)}

    assert one.commit(slow) == {"a": 2, "b": 2} and calls == [{}, {"b": 2}]
    assert two.read() == (2, {"a": 2, "b": 2})
    assert one.commit(lambda s: None) == {"a": 2, "b": 2} and one.read()[0] == 2
    for i in range(KEPT + 5):
        one.commit(lambda s, i=i: {"n": i})
    assert len(one.versions()) == KEPT and two.read()[1] == {"n": KEPT + 4}


def test_a_batch_appears_whole_or_not_at_all(spark, monkeypatch):
    store = JobStore(spark, new_scratch(spark, "atomic"))
    sites = rules(spark, rule("greenhouse"), rule("custom", company="C", ord_=1))
    run_into(store, captures(spark, board(1, 2)), sites, FILTERS, batch="b0")
    before = (sorted(map(tuple, store.jobs().collect())), store.run_log().count(), store.failures().count(), store.seen().count())

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as broken:
        broken.setattr(Manifest, "_published", lost)
        for batch in ("b0", "b1"):  # a retry and a new batch, both broken after their files were written
            with pytest.raises(RuntimeError):
                run_into(store, captures(spark, board(3)), sites, FILTERS, batch=batch)
    after = (sorted(map(tuple, store.jobs().collect())), store.run_log().count(), store.failures().count(), store.seen().count())
    assert after == before
    run_into(store, captures(spark, board(2, 3)), sites, FILTERS, batch="b0")
    assert {r.dedup_key for r in store.seen().collect()} == {"source:acme:2", "source:acme:3"}
    assert sorted(r.deduplication_key for r in store.jobs().collect()) == ["source:acme:2", "source:acme:3"]
    assert store.seen(excluding_batch="b0").count() == 0


def key_rows(spark, start, stop, batch="b"):
    return spark.range(start, stop).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("dedup_key"), F.lit(batch).alias("batch"))


def test_lookups_read_few_buckets(spark):
    table = KeyTable(spark, new_scratch(spark, "keys"), KEYS)
    segments = [table.write(key_rows(spark, 0, 300_000)), table.write(key_rows(spark, 300_000, 301_000))]
    absent = spark.range(1000).select(F.concat(F.lit("no"), F.col("id").cast("string")).alias("dedup_key"))
    assert sum(map(len, table.hits(absent, segments).values())) < 0.1 * 2 * keytable.BUCKETS
    asked = absent.unionByName(key_rows(spark, 299_990, 300_010).select("dedup_key")).unionByName(spark.sql("select cast(null as string) as dedup_key"))
    found = table.matching(asked, segments)
    assert found.count() < 0.2 * 301_000
    assert {r.dedup_key for r in asked.join(found, "dedup_key", "left_semi").collect()} == {f"k{i}" for i in range(299_990, 300_010)}
    assert table.matching(asked, []).count() == 0 and table.matching(asked.limit(0), segments).count() == 0


def test_no_key_is_missed(spark, monkeypatch):
    """Full filters only cost time: every stored key is found."""
    monkeypatch.setattr(keytable, "BLOCK_KEYS", 100_000)
    monkeypatch.setattr(keytable, "BUCKETS", 3)
    table = KeyTable(spark, new_scratch(spark, "keys"), KEYS)
    segment = table.write(key_rows(spark, 0, 20_000))
    keys = key_rows(spark, 0, 20_000)
    assert keys.join(table.matching(keys, [segment]), "dedup_key", "left_semi").count() == 20_000


def test_segments_are_merged(spark):
    store = JobStore(spark, new_scratch(spark, "merge"))
    empty = {c: "" for c in store.tables["jobs"].fieldNames()}

    def jobs(start, stop):
        return spark.createDataFrame([tuple({**empty, "deduplication_key": f"k{i}"}.values()) for i in range(start, stop)], store.tables["jobs"])

    for i in range(9):
        store.append_jobs(jobs(10 * i, 10 * i + 10), f"b{i}")
    assert len(store.state()["keys"]) < keytable.FAN
    assert sorted(r.dedup_key for r in store.seen().collect()) == sorted(f"k{i}" for i in range(90))
    # A batch in a merged segment is replaced.
    store.append_jobs(jobs(500, 501), "b1")
    assert sorted(r.dedup_key for r in store.seen().collect()) == sorted([*(f"k{i}" for i in range(90) if i // 10 != 1), "k500"])
    assert store.jobs().where("batch = 'b1'").count() == 1
    asked = spark.createDataFrame([("k500",), ("k15",), ("k25",)], "dedup_key string")
    assert {r.dedup_key for r in asked.join(store.seen_among(asked), "dedup_key", "left_semi").collect()} == {"k500", "k25"}
    assert asked.join(store.seen_among(asked, excluding_batch="b2"), "dedup_key", "left_semi").count() == 1


def test_sightings_add_up_after_any_time(spark):
    base = new_scratch(spark, "sightings")
    schema = "dedup_key string, at timestamp"
    rows = [("a", datetime(2020 + i, 1, 1)) for i in range(6)] + [("b", datetime(2024, 5, 1)), (None, datetime(2024, 1, 1))]
    for i in range(6):
        part = spark.createDataFrame(rows[i : i + 1] if i < 5 else rows[5:], schema)
        part.write.mode("append").parquet(f"{base}/landing")
        keep_sightings(spark, f"{base}/landing", part.schema, f"{base}/table", f"{base}/checkpoint", "at")
    table = SightingsTable(spark, f"{base}/table")
    assert {(r.dedup_key, r.first_seen.year, r.last_seen.year, r.n_seen) for r in table.rows().collect()} == {("a", 2020, 2025, 6), ("b", 2024, 2024, 1)}
    assert [r.n_seen for r in table.of(spark.createDataFrame([("a",), ("z",)], "dedup_key string")).collect()] == [6]
    table.add("again", spark.createDataFrame(rows[:1], schema), "at")
    table.add("again", spark.createDataFrame(rows[:1], schema), "at")
    assert table.of(spark.createDataFrame([("a",)], "dedup_key string")).first().n_seen == 7


# -- details that land later --------------------------------------------------------------------

LISTED = '<a class="x" href="/jobs/{0}/role/job">Engineer {0}</a>'


def icims_list(*ids, run_id="r1", page_no=0):
    return capture("icims", "<html>" + "".join(LISTED.format(i) for i in ids) + "</html>", page_no=page_no, run_id=run_id, url="https://acme.example.com/jobs/search?pr=0")


def icims_detail(i, run_id="r1"):
    posting = {"@type": "JobPosting", "title": f"Engineer no {i}", "jobLocation": {"address": {"addressLocality": "Oslo"}}}
    page = f'<script type="application/ld+json">{json.dumps(posting)}</script>'
    return detail("icims", f"https://acme.example.com/jobs/{i}/role/job", page, run_id=run_id, url=f"https://acme.example.com/jobs/{i}/role/job")


def end(run_id="r1", company="Acme"):
    return (run_id, company, None, END, None, None, None, None, None, None, None)


def streamed(spark, parts, filters=FILTERS, sites=None):
    base = new_scratch(spark, "late")
    store = JobStore(spark, f"{base}/store")
    sites = sites or rules(spark, rule("icims"), rule("greenhouse", company="G", ord_=1))
    seen = []
    for part in parts:
        captures(spark, *part).write.mode("append").parquet(f"{base}/landing")
        run_incremental(spark, f"{base}/landing", store, sites, f"{base}/checkpoint", filters)
        seen.append(sorted(r.source_job_id for r in store.jobs().collect()))
    return seen, store, sites


def test_details_of_a_later_batch(spark):
    pages = [icims_list(1, 2, 3), icims_detail(1), icims_detail(2), icims_detail(3)]
    whole = run(captures(spark, *pages), rules(spark, rule("icims")), FILTERS)
    want = sorted((r.source_job_id, r.title, r.location) for r in whole.new_jobs.collect())
    assert len(want) == 3
    # Some details before their list, others after it, the end of all companies' run last.
    seen, store, _ = streamed(spark, [pages[2:], pages[:2], [end(company=None)]])
    assert seen[:-1] == [[], []]
    assert sorted((r.source_job_id, r.title, r.location) for r in store.jobs().collect()) == want
    assert PendingCaptures(store).waiting().count() == 0


def test_a_detail_that_never_comes(spark):
    anywhere = GlobalFilters(title_keywords=["engineer"], locations=[], seniority_exclude=[], exclude_keywords=[])
    seen, store, _ = streamed(spark, [[icims_list(1, 2), icims_detail(1)], [end()]], anywhere, rules(spark, rule("icims")))
    assert seen == [[], ["1", "2"]]
    assert {(r.source_job_id, r.title) for r in store.jobs().collect()} == {("1", "Engineer no 1"), ("2", "Engineer 2")}


def test_open_runs_wait_and_ended_ones_do_not(spark):
    g = capture("greenhouse", {"jobs": [{"id": 9, "title": "Engineer", "location": {"name": "Oslo"}}]}, company="G")
    parts = [
        [icims_list(1), icims_detail(1), g],  # the board has no details and does not wait
        [icims_list(2, run_id="r2"), icims_detail(2, run_id="r2"), end("r1")],
        [icims_detail(3, run_id="r1"), icims_list(3, run_id="r1")],  # late pages of an ended run
        [end("r3")],  # a later end ends r2 too
        [end("r3")],
    ]
    seen, store, _ = streamed(spark, parts)
    assert seen == [["9"], ["1", "9"], ["1", "3", "9"], ["1", "2", "3", "9"], ["1", "2", "3", "9"]]
    assert store.state()["pending"] == [] and store.run_log().count() == 5
