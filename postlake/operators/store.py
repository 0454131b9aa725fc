"""Stored batches, and the `jobs`, `run_log` and `failures` tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.operators.keytable import KeyTable
from postlake.operators.manifest import Manifest
from postlake.schema import FAILURES, JOB_HEADERS, JOBS, KEYS, RUN_LOG, RUN_LOG_HEADERS, column_name


def iso_timestamp(c: Column | str) -> Column:
    """ISO text with offset; fractions only where there are any."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    fraction = F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros))
    return F.concat(whole, fraction, F.lit("+00:00"))


def to_job_rows(postings: DataFrame) -> DataFrame:
    """The fifteen output columns, missing values as empty text."""
    values = {
        "Company": F.col("company"),
        "Title": F.col("title"),
        "Location": F.col("location"),
        "Department": F.col("department"),
        "Employment Type": F.col("employment_type"),
        "Date Posted": F.date_format("date_posted", "yyyy-MM-dd"),
        "First Seen": iso_timestamp("fetched_at"),
        "Match Reason": F.col("match_reason"),
        "Posting URL": F.col("posting_url"),
        "Application URL": F.col("application_url"),
        "Source": F.col("source"),
        "Source Job ID": F.col("source_job_id"),
        "Deduplication Key": F.col("dedup_key"),
        "Status": F.col("match_status"),
        "Notes": F.lit(""),
    }
    return postings.select(
        *[F.coalesce(values[h], F.lit("")).alias(column_name(h)) for h in JOB_HEADERS]
    )


def to_run_log(summary: DataFrame, run_ts: Column, seconds: Column) -> DataFrame:
    """The columns of the run-log table: the number of failures and their texts, one per line; duration to two decimals."""
    return summary.select(
        iso_timestamp(run_ts).alias("run_timestamp"),
        "companies_checked",
        "jobs_fetched",
        "jobs_matched",
        "new_jobs_inserted",
        "duplicates_skipped",
        "failures",
        "failure_texts",
        F.round(seconds, 2).alias("execution_duration_seconds"),
    )


def run_log_rows(log: DataFrame) -> DataFrame:
    """The eight output columns of the run log, in which the failures are their texts, one per line."""
    values = {"Failures": F.col("failure_texts")}
    return log.select(*[values.get(h, F.col(column_name(h))).alias(column_name(h)) for h in RUN_LOG_HEADERS])


class BatchStore:
    """Tables under one folder whose batches appear together or not at all.

    Every write goes to folders of its own; one manifest version then names them. A batch that is written again
    replaces its rows, also by nothing, and a driver lost on the way leaves the old state whole. The keys of stored rows
    are kept in a `KeyTable`, which is part of the same version.

    tables: schema by name. keys: the table and column whose values are the keys.
    """

    def __init__(self, spark: SparkSession, base: str, tables: dict[str, T.StructType], keys: tuple[str, str]) -> None:
        self.spark = spark
        self.base = base.rstrip("/")
        self.tables = tables
        self.keys = keys
        self.manifest = Manifest(spark, self.base)
        self.key_table = KeyTable(spark, f"{self.base}/keys", KEYS)

    def state(self) -> dict:
        return {"batches": {}, "keys": [], **self.manifest.read()[1]}

    def ensure_tables(self) -> None:
        """A first, empty version; an existing store is left alone."""
        self.manifest.commit(lambda state: None if state else {"batches": {}, "keys": []})

    def read(self, table: str) -> DataFrame:
        """Rows of a table with the batch that they came with."""
        full = T.StructType([*self.tables[table].fields, T.StructField("batch", T.StringType())])
        paths = [held[table] for held in self.state()["batches"].values() if table in held]
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(*paths)

    def has(self, batch: str) -> bool:
        return batch in self.state()["batches"]

    def put(self, batch: str, rows: dict[str, DataFrame], also: Callable[[dict], None] | None = None) -> None:
        """Publish the rows of a batch's tables at once; `also` changes the state in the same version."""
        paths = {}
        for table, df in rows.items():
            paths[table] = f"{self.base}/{table}/{uuid.uuid4().hex}"
            df.select(self.tables[table].fieldNames()).withColumn("batch", F.lit(batch)).write.parquet(paths[table])
        segment = None
        table, column = self.keys
        if table in paths:
            stored = self.spark.read.schema(f"`{column}` string, batch string").parquet(paths[table])
            keys = stored.select(F.col(f"`{column}`").alias("dedup_key"), "batch").where("dedup_key <> ''").distinct()
            segment = self.key_table.write(keys)

        def change(state: dict) -> dict:
            state = {"batches": {}, "keys": [], **state}
            before = state["batches"].get(batch, {})
            if segment is not None:
                if table in before:
                    for held in state["keys"]:
                        held["without"] = sorted({*held["without"], batch})
                if segment["rows"]:
                    state["keys"].append(segment)
            state["batches"][batch] = {**before, **paths}
            if also is not None:
                also(state)
            return state

        self.manifest.commit(change)
        self._merge_keys()

    def _merge_keys(self) -> None:
        """Merge crowded key segments; a store that changed meanwhile keeps them for the next commit."""
        crowd = self.key_table.crowded(self.state()["keys"])
        if not crowd:
            return
        one = self.key_table.merged(crowd)

        def change(state: dict) -> dict | None:
            if not all(s in state["keys"] for s in crowd):
                return None
            state["keys"] = [s for s in state["keys"] if s not in crowd] + ([one] if one["rows"] else [])
            return state

        self.manifest.commit(change)

    def _segments(self, excluding_batch: str | None) -> list[dict]:
        held = self.state()["keys"]
        if excluding_batch is None:
            return held
        return [{**s, "without": [*s["without"], excluding_batch]} for s in held]

    def seen(self, excluding_batch: str | None = None) -> DataFrame:
        """Keys of all stored rows; a batch being retried does not count its own rows as seen.

        Joins against them need no distinct.
        """
        return self.key_table.rows(self._segments(excluding_batch)).select("dedup_key")

    def seen_among(self, keys: DataFrame, excluding_batch: str | None = None) -> DataFrame:
        """All stored keys that are among `keys`, and some others: only the buckets that can hold one are read."""
        return self.key_table.matching(keys, self._segments(excluding_batch)).select("dedup_key")


class JobStore(BatchStore):
    """The `jobs`, `run_log` and `failures` tables under one folder."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        tables = {"jobs": JOBS, "run_log": RUN_LOG, "failures": FAILURES}
        super().__init__(spark, base, tables, ("jobs", "deduplication_key"))

    def jobs(self) -> DataFrame:
        return self.read("jobs")

    def run_log(self) -> DataFrame:
        return self.read("run_log")

    def failures(self) -> DataFrame:
        return self.read("failures")

    def append_jobs(self, rows: DataFrame, batch: str) -> None:
        self.put(batch, {"jobs": rows})

    def append_failures(self, rows: DataFrame, batch: str) -> None:
        self.put(batch, {"failures": rows})

    def append_run_log(self, rows: DataFrame, batch: str) -> None:
        self.put(batch, {"run_log": rows})


def read_seen(table: DataFrame, header: str = "Deduplication Key") -> DataFrame:
    """Distinct non-empty keys of any table, found by column name; no such column, no keys."""
    by_name = {c.lower().replace(" ", "_"): c for c in table.columns}
    found = by_name.get(column_name(header))
    if found is None:
        return table.sparkSession.createDataFrame([], "dedup_key string")
    keys = table.select(F.col(f"`{found}`").alias("dedup_key"))
    return keys.where("dedup_key is not null and dedup_key <> ''").distinct()
