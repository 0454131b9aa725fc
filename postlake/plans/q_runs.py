"""Queries S15-S20 and T01-T03: stored runs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.operators import dedup as E
from postlake.operators import report as P
from postlake.operators.rules import GlobalFilters
from postlake.operators.store import JobStore, read_seen, run_log_rows, to_job_rows, to_run_log
from postlake.plans import sites, views
from postlake.plans.oracle import norm
from postlake.plans.pipeline import run_into
from postlake.plans.q_rules import STAR_CTES, _EVEN_SEEN, _REASON, even_seen, _matched, star_decided
from postlake.plans.q_sources import ICIMS_SQL
from postlake.plans.registry import query, table
from postlake.session import materialize, new_scratch
from postlake.streaming.incremental import (
    END,
    SightingsTable,
    keep_new_keys,
    keep_sightings,
    kept_store,
    run_incremental,
    stream_dedup,
)

_FIRST = """x as (select *, row_number() over (partition by dedup_key order by company_ord, l_shipdate, l_partkey, l_linenumber) as rn
       from d where reason_class = 'matched'), first as (select * from x where rn = 1)"""


def _new_star_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_job_rows(E.first_in_run(_matched(star_decided(spark, sf_dir)), views.STAR_ORDER))


@query("S15_read_seen", f"with {STAR_CTES} select distinct dedup_key from d where reason_class = 'matched'")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys found by header name, in a table written twice."""
    path = new_scratch(spark, "jobs")
    rows = _new_star_jobs(spark, sf_dir)
    rows.write.parquet(path)
    stored = spark.read.parquet(path)
    blank = stored.withColumn("deduplication_key", F.lit(""))
    return read_seen(stored.unionByName(stored).unionByName(blank))


@query("S16_job_rows", f"""
  with {STAR_CTES}, {_FIRST}
  select company, title, location, department, employment_type, strftime(l_shipdate, '%Y-%m-%d') as date_posted,
         strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' as first_seen, {_REASON} as match_reason, '' as posting_url, '' as application_url,
         'star' as source, source_job_id, dedup_key as deduplication_key, 'matched' as status, '' as notes from first""")
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _new_star_jobs(spark, sf_dir)


@query("S17_append_jobs", f"""
  with {STAR_CTES}, {_FIRST}
  select case when l_orderkey % 2 = 0 then 'b0' else 'b1' end as batch, dedup_key as deduplication_key, company from first""")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, the second written twice as after a retry. The postings are decided once and written for all three."""
    store = JobStore(spark, new_scratch(spark, "store"))
    store.ensure_tables()
    matched = materialize(_matched(star_decided(spark, sf_dir)).drop("description", "matched_keywords"), "matched")
    even = E.first_in_run(matched.where("l_orderkey % 2 = 0"), views.STAR_ORDER)
    store.append_jobs(to_job_rows(even), "b0")
    for _ in range(2):
        odd = E.new_postings(matched, store.seen(excluding_batch="b1"), views.STAR_ORDER)
        store.append_jobs(to_job_rows(odd), "b1")
    return store.jobs().select("batch", "deduplication_key", "company")


@query("S18_append_run_log", f"""
  with {STAR_CTES}, {_EVEN_SEEN}
  select '2026-07-20T06:00:00.250000+00:00' as run_timestamp, (select count(*) from supplier) as companies_checked, count(*) as jobs_fetched,
         count(*) filter (reason_class = 'matched') as jobs_matched,
         count(distinct dedup_key) filter (reason_class = 'matched' and dedup_key not in (select dedup_key from seen)) as new_jobs_inserted,
         count(*) filter (reason_class = 'matched') - count(distinct dedup_key) filter (reason_class = 'matched' and dedup_key not in (select dedup_key from seen)) as duplicates_skipped,
         '' as failures, cast(1.23 as double) as execution_duration_seconds from d""")
def s18(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = star_decided(spark, sf_dir)
    results = P.company_results(views.star_rules(spark, sf_dir), decided, even_seen(spark, sf_dir))
    store = JobStore(spark, new_scratch(spark, "store"))
    at = F.lit("2026-07-20 06:00:00.25").cast("timestamp")
    store.append_run_log(to_run_log(P.run_summary(results), at, F.lit(1.2345)), "b0")
    return run_log_rows(store.run_log())


@query("S19_ensure_tables", f"""
  with {STAR_CTES}, {_FIRST} select 'before' as step, 0 as n union all select 'after', count(*) from first union all select 'again', count(*) from first""")
def s19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing tables are created empty; tables with rows stay as they are."""
    store = JobStore(spark, new_scratch(spark, "store"))
    store.ensure_tables()
    before = store.jobs().count()
    store.append_jobs(_new_star_jobs(spark, sf_dir), "b0")
    after = store.jobs().agg(F.count(F.lit(1)).alias("n")).select(F.lit("after").alias("step"), "n")
    store.ensure_tables()
    again = store.jobs().agg(F.count(F.lit(1)).alias("n")).select(F.lit("again").alias("step"), "n")
    return after.unionByName(again).unionByName(spark.range(1).select(F.lit("before").alias("step"), F.lit(before).cast("bigint").alias("n")))


# -- captures of order sites through whole runs -------------------------------------------------

SITE_FILTERS = GlobalFilters(
    title_keywords=["urgent", "high", "medium"], description_keywords=["more"], exclude_keywords=["4-not"],
    locations=["City 1", "city 3", "Remote"], seniority_exclude=["untitled"],
)

# Greenhouse sites under SITE_FILTERS, in SQL. City 1 is no substring of another city number below 7.
SITE_CTES = f"""
  site as ({sites.ORDERS_SQL}),
  j as (select *, case when n % 11 = 0 then 'untitled role' else lower(o_orderpriority) end as t,
               n % 5 <> 0 and o_custkey % 7 in (1, 3) as there, n % 4 <> 0 as has_text from site),
  m as (select *, not contains(t, '4-not') and not contains(t, 'untitled') and there
               and (contains(t, 'urgent') or contains(t, 'high') or contains(t, 'medium') or has_text) as hit,
               'source:' || {norm('company')} || ':' || n as dedup_key from j)"""


@query("S20_dry_run", f"""
  with {SITE_CTES} select company, count(*) as jobs_fetched, count(*) filter (hit) as jobs_matched, count(*) filter (hit) as new_jobs_inserted,
         cast(0 as bigint) as duplicates_skipped from m group by 1""")
def s20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No store is touched: all matched postings count as new."""
    captures, rules = sites.greenhouse(spark, sf_dir)
    store = JobStore(spark, new_scratch(spark, "never-written"))
    done = run_into(store, captures, rules, SITE_FILTERS, batch="b0", dry_run=True)
    return done.results.drop("company_ord", "failures")


def _cycle(page_no: str) -> str:
    return f"case when {page_no} < 5 then 0 when {page_no} < 9 then 1 else 2 end"


def _landing(spark: SparkSession, sf_dir: str):
    captures, rules = sites.greenhouse(spark, sf_dir)
    # The second cycle fetches pages 3 and 4 again, the third one page 0.
    cycles = [
        captures.where("page_no < 5"),
        captures.where("page_no between 3 and 8").withColumn("run_id", F.lit("r2")),
        captures.where("page_no > 8 or page_no = 0").withColumn("run_id", F.lit("r3")),
    ]
    return cycles, rules


@query("T01_incremental_run", f"""
  with {SITE_CTES} select company, n, cast(case when page_no < 5 then 0 when page_no < 9 then 1 else 2 end as bigint) as cycle from m where hit""")
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fetch cycles through the stream; each one appends what earlier cycles had not."""
    cycles, rules = _landing(spark, sf_dir)
    base = new_scratch(spark, "cycles")
    store = JobStore(spark, f"{base}/store")
    for cycle in cycles:
        cycle.write.mode("append").parquet(f"{base}/landing")
        run_incremental(spark, f"{base}/landing", store, rules, f"{base}/checkpoint", SITE_FILTERS)
    return store.jobs().select(
        "company", F.col("source_job_id").cast("bigint").alias("n"), F.regexp_extract("batch", "([0-9]+)$", 1).cast("bigint").alias("cycle")
    )


@query("T01_run_log", f"""
  with {SITE_CTES}, c as (select *, {_cycle('page_no')} as cycle from m),
  fetched as (select 0 as cycle, count(*) filter (page_no < 5) as f, count(*) filter (page_no < 5 and hit) as h from m
    union all select 1, count(*) filter (page_no between 3 and 8), count(*) filter (page_no between 3 and 8 and hit) from m
    union all select 2, count(*) filter (page_no > 8 or page_no = 0), count(*) filter ((page_no > 8 or page_no = 0) and hit) from m),
  fresh as (select cycle, count(*) filter (hit) as n from c group by 1)
  select cast(fetched.cycle as bigint) as cycle, (select count(distinct c) from site) as companies_checked, f as jobs_fetched, h as jobs_matched,
         coalesce(fresh.n, 0) as new_jobs_inserted, h - coalesce(fresh.n, 0) as duplicates_skipped from fetched left join fresh using (cycle)""")
def t01_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    cycles, rules = _landing(spark, sf_dir)
    base = new_scratch(spark, "cycles")
    store = JobStore(spark, f"{base}/store")
    for number, cycle in enumerate(cycles):
        run_into(store, cycle, rules, SITE_FILTERS, batch=f"b{number}")
    log = store.run_log()
    return log.select(
        F.regexp_extract("batch", "([0-9]+)$", 1).cast("bigint").alias("cycle"), "companies_checked", "jobs_fetched", "jobs_matched",
        "new_jobs_inserted", "duplicates_skipped",
    )


@query("T01_pending_details", f"""
  with p as ({ICIMS_SQL}) select company, source_job_id, title, location, employment_type, date_posted from p where location is not null""")
def t01_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List pages, detail pages and the end marker land in three batches. Only details have locations, which the filter asks for."""
    captures, rules = sites.icims(spark, sf_dir)
    rules = rules.withColumn("location_filters", F.array(F.lit("City")))
    base = new_scratch(spark, "pending")
    store = JobStore(spark, f"{base}/store")
    mark = captures.select("run_id").distinct().withColumn("kind", F.lit(END))
    filters = GlobalFilters(title_keywords=["—"], seniority_exclude=[], exclude_keywords=[])
    for part in (captures.where("kind = 'list'"), captures.where("kind = 'detail'"), mark):
        landed = captures.limit(0).unionByName(part, allowMissingColumns=True)
        landed.write.mode("append").parquet(f"{base}/landing")
        run_incremental(spark, f"{base}/landing", store, rules, f"{base}/checkpoint", filters)
    return store.jobs().select("company", "source_job_id", "title", "location", "employment_type", "date_posted")


# -- events as a stream of sightings ------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), key.alias("dedup_key")
    )


def _slices(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = _events(spark, sf_dir)
    day = F.dayofmonth("ts")
    return [rows.where(day <= 10), rows.where((day > 10) & (day <= 20)), rows.where(day > 20)]


@query("T01_seen_keys", """
  with e as (select *, user_id || ':' || event_type as dedup_key, case when day(ts) <= 10 then 0 when day(ts) <= 20 then 1 else 2 end as cycle from events),
  x as (select *, row_number() over (partition by dedup_key order by cycle, ts, event_id) as rn from e)
  select dedup_key, event_id, cast(cycle as bigint) as cycle from x where rn = 1""")
def t01_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = new_scratch(spark, "keys")
    for part in _slices(spark, sf_dir):
        part.write.mode("append").parquet(f"{base}/landing")
        keep_new_keys(spark, f"{base}/landing", part.schema, f"{base}/kept", f"{base}/checkpoint", ["ts", "event_id"])
    kept = kept_store(spark, f"{base}/kept", part.schema).read("kept")
    return kept.select("dedup_key", "event_id", F.regexp_extract("batch", "([0-9]+)$", 1).cast("bigint").alias("cycle"))


@query("T02_stream_dedup", "select distinct user_id || ':' || event_type as dedup_key from events")
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The horizon covers the month of the data, so the stream keeps every key exactly once."""
    base = new_scratch(spark, "dedup")
    for part in _slices(spark, sf_dir):
        part.write.mode("append").parquet(f"{base}/landing")
        arrived = spark.readStream.schema(part.schema).parquet(f"{base}/landing")
        (
            stream_dedup(arrived, "ts", "60 days").select("dedup_key")
            .writeStream.format("parquet").option("path", f"{base}/kept").option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True).start().awaitTermination()
        )
    return spark.read.parquet(f"{base}/kept").select("dedup_key")


_SIGHTINGS = """
  select user_id || ':' || event_type as dedup_key, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first_seen,
         strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_seen, count(*) as n_seen from events group by 1"""


def _shown_sightings(df: DataFrame) -> DataFrame:
    return df.select(
        "dedup_key", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"),
        F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "n_seen",
    )


@query("T03_sightings", _SIGHTINGS)
def t03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_sightings(E.sightings(_events(spark, sf_dir), "ts"))


@query("T03_stream_sightings", _SIGHTINGS)
def t03_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream, kept as a table that every batch adds to."""
    base = new_scratch(spark, "sightings")
    for part in _slices(spark, sf_dir):
        part.write.mode("append").parquet(f"{base}/landing")
        keep_sightings(spark, f"{base}/landing", part.schema, f"{base}/table", f"{base}/checkpoint", "ts")
    return _shown_sightings(SightingsTable(spark, f"{base}/table").rows())


@query("T02_exact_dedup", "select distinct user_id || ':' || event_type as dedup_key from events")
def t02_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key once, by the key table instead of streaming state: no horizon."""
    base = new_scratch(spark, "exact")
    for part in _slices(spark, sf_dir):
        part.write.mode("append").parquet(f"{base}/landing")
        keep_new_keys(spark, f"{base}/landing", part.schema, f"{base}/kept", f"{base}/checkpoint", ["ts", "event_id"])
    return kept_store(spark, f"{base}/kept", part.schema).read("kept").select("dedup_key")
