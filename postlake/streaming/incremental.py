"""The periodic run as a stream over landed captures, and key tables that streams keep."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.functions.text import strip
from postlake.operators.assemble import first_wins
from postlake.operators.dedup import merge_sightings, sightings
from postlake.operators.keytable import KeyTable
from postlake.operators.manifest import Manifest
from postlake.operators.rules import GlobalFilters
from postlake.operators.store import BatchStore, JobStore
from postlake.plans.pipeline import run_into
from postlake.schema import CAPTURES, SIGHTINGS
from postlake.session import materialize
from postlake.sources import DETAIL_SOURCES

#: `kind` of the capture that says that a company's run has landed whole; without a company, all of the run.
END = "end"
_ENDED = "company string, run_id string"


def batch_name(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    """Name of a micro-batch: the id that its checkpoint keeps for the query, and its number."""
    held = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()
    query = json.loads(held.value)["id"]
    return f"{query}-{batch_id:010d}"


def _each_batch(arrived: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    query = (
        arrived.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


class PendingCaptures:
    """Captures of runs that have not landed whole, kept until their end marker arrives.

    A list row of a site with detail pages can only be decided with its detail, and which rows repeat earlier ones
    (by id or requisition) only with the whole run. So list and detail pages of such sites wait, in any order, for the
    capture of kind END of their company and run; a detail that has not come by then is missing, and its list row counts
    alone. Run ids of a company ascend in time: the end of a run ends all earlier ones. The manifest holds the waiting
    segments, each written once, and the latest ended run of each company; what lies at or before it has been released.
    """

    def __init__(self, store: JobStore) -> None:
        self.store = store
        self.spark = store.spark

    def _ended(self, state: dict) -> DataFrame:
        if "ended" not in state:
            return self.spark.createDataFrame([], _ENDED)
        return self.spark.read.schema(_ENDED).parquet(state["ended"])

    @staticmethod
    def _until(captures: DataFrame, ended: DataFrame) -> DataFrame:
        """Captures with the run that their company's ends reach, null if none."""
        own = ended.where("company is not null").withColumnRenamed("run_id", "own_end")
        every = ended.where("company is null").agg(F.max("run_id")).first()[0]
        joined = captures.join(own, "company", "left")
        return joined.withColumn("_end", F.greatest("own_end", F.lit(every).cast("string"))).drop("own_end")

    def taken(self, batch: DataFrame, rules: DataFrame) -> tuple[DataFrame, Callable[[dict], None] | None]:
        """Captures of this batch or earlier ones that can be decided now, and how the state changes with them."""
        state = self.store.state()
        before = self._ended(state)
        batch = batch.withColumn("company", strip("company"))
        marks = batch.where(F.col("kind") == END).select("company", "run_id").distinct()
        arrived = batch.where(F.col("kind") != END)
        wants = F.coalesce(F.lower(F.col("extra")["fetch_details"]) != "false", F.lit(True))
        sites = rules.where(F.col("source_type").isin(DETAIL_SOURCES) & wants)
        sites = sites.select(strip("company").alias("company"), "source_type").distinct()
        waits = arrived.join(sites, ["company", "source_type"], "left_semi")
        at_once = arrived.join(sites, ["company", "source_type"], "left_anti")
        ended = before.unionByName(marks).groupBy("company").agg(F.max("run_id").alias("run_id"))
        any_mark = not marks.isEmpty()
        if any_mark:
            path = f"{self.store.base}/ended/{uuid.uuid4().hex}"
            ended.write.parquet(path)
            ended = self.spark.read.schema(_ENDED).parquet(path)
        open_now = F.col("_end").isNull() | (F.col("run_id") > F.col("_end"))
        placed = self._until(waits, ended)
        ready = placed.where(~open_now).drop("_end").unionByName(at_once)
        segments = list(state.get("pending", []))
        if any_mark and segments:
            held = self._until(self._segments(segments), before).where(open_now).drop("_end")
            ready = ready.unionByName(self._until(held, ended).where(~open_now).drop("_end"))
            still = self._until(self._segments(segments, path=True).select("path", "company", "run_id"), ended)
            kept = {row["path"] for row in still.where(open_now).select("path").distinct().collect()}
            segments = [s for s in segments if s in kept]
        fresh = f"{self.store.base}/pending/{uuid.uuid4().hex}"
        placed.where(open_now).select(CAPTURES.fieldNames()).write.parquet(fresh)
        if not self.spark.read.schema(CAPTURES).parquet(fresh).isEmpty():
            segments.append(fresh)

        def change(new: dict) -> None:
            new["pending"] = segments
            if any_mark:
                new["ended"] = path

        return ready.select(CAPTURES.fieldNames()), change

    def _segments(self, paths: list[str], path: bool = False) -> DataFrame:
        rows = self.spark.read.schema(CAPTURES).parquet(*paths)
        if path:
            # A segment is the folder of its files.
            rows = rows.withColumn("file", F.col("_metadata.file_path"))
            named = self.spark.createDataFrame([(p, p.rsplit("/", 1)[1]) for p in paths], "path string, name string")
            rows = rows.withColumn("name", F.element_at(F.split("file", "/"), -2)).join(F.broadcast(named), "name")
        return rows

    def waiting(self) -> DataFrame:
        """The captures that wait now."""
        state = self.store.state()
        if not state.get("pending"):
            return self.spark.createDataFrame([], CAPTURES)
        placed = self._until(self._segments(state["pending"]), self._ended(state))
        return placed.where(F.col("_end").isNull() | (F.col("run_id") > F.col("_end"))).select(CAPTURES.fieldNames())


def run_incremental(
    spark: SparkSession,
    landing: str,
    store: JobStore,
    rules: DataFrame,
    checkpoint: str,
    filters: GlobalFilters | None = None,
) -> None:
    """Process every capture that landed since the last call, then stop.

    A micro-batch publishes its jobs, failures, run log and waiting captures as one version of the store, under the
    name of its checkpoint's query and its number. One that runs again after it was published does nothing, and a new
    checkpoint on the same store replaces nothing. Sites with detail pages wait for the end of their run.
    """
    arrived = spark.readStream.schema(CAPTURES).parquet(landing)
    fetched = F.col("status").isNull() | F.col("status").between(200, 299)

    def handle(batch: DataFrame, batch_id: int) -> None:
        name = batch_name(batch.sparkSession, checkpoint, batch_id)
        if store.has(name):
            return
        ready, change = PendingCaptures(store).taken(batch.where(fetched | (F.col("kind") == END)), rules)
        failed = batch.where(~fetched & (F.col("kind") != END))
        run_into(store, ready, rules, filters, batch=name, failed=failed, also=change)

    _each_batch(arrived, checkpoint, handle)


def kept_store(spark: SparkSession, target: str, schema: T.StructType) -> BatchStore:
    """The store of `keep_new_keys`: its table `kept` has the first row of every key."""
    return BatchStore(spark, target, {"kept": schema}, ("kept", "dedup_key"))


def keep_new_keys(
    spark: SparkSession, landing: str, schema: T.StructType, target: str, checkpoint: str, order: list[str]
) -> None:
    """The seen-set step alone, for rows that carry a `dedup_key` already.

    Each micro-batch keeps the first row per key and drops keys of earlier batches, however long ago; of the stored
    keys it reads the buckets that can hold its own.
    """
    arrived = spark.readStream.schema(schema).parquet(landing)
    store = kept_store(spark, target, schema)

    def handle(batch: DataFrame, batch_id: int) -> None:
        name = batch_name(batch.sparkSession, checkpoint, batch_id)
        if store.has(name):
            return
        fresh = first_wins(batch, ["dedup_key"], order)
        earlier = store.seen_among(batch.select("dedup_key").distinct())
        store.put(name, {"kept": fresh.join(earlier, "dedup_key", "left_anti")})

    _each_batch(arrived, checkpoint, handle)


class SightingsTable:
    """First and last sighting and count of every key, in merged segments under a manifest.

    A batch adds one segment of its own keys' sums; segments of like size are merged, so no state is held by the stream
    and none is rewritten whole. A key that returns after any time adds to what is known.
    """

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.manifest = Manifest(spark, base)
        self.table = KeyTable(spark, f"{base.rstrip('/')}/segments", SIGHTINGS, merge_sightings)

    def _segments(self) -> list[dict]:
        return self.manifest.read()[1].get("segments", [])

    def add(self, batch: str, rows: DataFrame, at: str = "fetched_at") -> None:
        """Count the rows of a batch, once however often it runs."""
        if batch in self.manifest.read()[1].get("batches", []):
            return
        segment = self.table.write(materialize(sightings(rows.where("dedup_key is not null"), at), "sightings"))

        def change(state: dict) -> dict | None:
            done = state.get("batches", [])
            if batch in done:
                return None
            held = state.get("segments", []) + ([segment] if segment["rows"] else [])
            return {"segments": held, "batches": [*done, batch]}

        self.manifest.commit(change)
        crowd = self.table.crowded(self._segments())
        if crowd:
            one = self.table.merged(crowd)

            def merge(state: dict) -> dict | None:
                if not all(s in state["segments"] for s in crowd):
                    return None
                return {**state, "segments": [s for s in state["segments"] if s not in crowd] + [one]}

            self.manifest.commit(merge)

    def rows(self) -> DataFrame:
        """(dedup_key, first_seen, last_seen, n_seen) of every key."""
        return merge_sightings(self.table.rows(self._segments()))

    def of(self, keys: DataFrame) -> DataFrame:
        """The same for the given keys; only buckets that can hold one are read."""
        found = self.table.matching(keys, self._segments()).join(keys.select("dedup_key").distinct(), "dedup_key", "left_semi")
        return merge_sightings(found)


def keep_sightings(
    spark: SparkSession, landing: str, schema: T.StructType, target: str, checkpoint: str, at: str = "fetched_at"
) -> None:
    """Add everything that landed since the last call to the sightings table, then stop."""
    arrived = spark.readStream.schema(schema).parquet(landing)
    table = SightingsTable(spark, target)

    def handle(batch: DataFrame, batch_id: int) -> None:
        table.add(batch_name(batch.sparkSession, checkpoint, batch_id), batch, at)

    _each_batch(arrived, checkpoint, handle)


def stream_dedup(stream: DataFrame, at: str, horizon: str) -> DataFrame:
    """First row per key as streaming state.

    State is dropped once the watermark passes a key's first sighting by `horizon`; a key seen again
    later counts as new. Exact for repeats inside the horizon, `keep_new_keys` is exact for all.
    """
    return stream.withWatermark(at, horizon).dropDuplicatesWithinWatermark(["dedup_key"])
