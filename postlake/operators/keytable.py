"""A table of keys that grows: segments in hash buckets, with Bloom filters that say which buckets to read.

A commit adds one segment. A segment's rows lie in folders by bucket of the key; next to them lie Bloom filters, one
or more blocks of BLOCK_BITS bits for each bucket, built by bitmap aggregates. A lookup tests its keys against the
filters and reads only the buckets that can hold one of them. Segments of like size are merged by FAN, so a key is
rewritten a logarithmic number of times and a lookup meets a logarithmic number of segments.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most buckets of a segment, and the keys that are worth one more.
BUCKETS = 256
BUCKET_KEYS = 1_000
#: Segments of like size that are merged.
FAN = 4
#: Bits of a filter block (what one bitmap aggregate holds), keys that share one, and bits set by a key.
BLOCK_BITS = 32_768
BLOCK_KEYS = 3_000
HASHES = 6

Merge = Callable[[DataFrame], DataFrame]


def _bits(key: str) -> Column:
    """Positions of a key in its block."""
    step = f"(xxhash64({key}, 2) | 1)"
    return F.expr(f"transform(sequence(0, {HASHES - 1}), i -> pmod(xxhash64({key}, 1) + i * (pmod({step}, 1048576)), {BLOCK_BITS}))")


def _block(key: str) -> Column:
    return F.expr(f"cast(pmod(xxhash64({key}, 3), blocks) as int)")


class KeyTable:
    """Segments are described by dicts that a manifest keeps: path, rows, buckets, and batches left out.

    schema: the columns of a row, `dedup_key` among them. merge: what rows of merged segments become; a `batch` column, if
    there is one, names the batch that a row came with.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, merge: Merge | None = None) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.schema = schema
        self.merge = merge or (lambda rows: rows)

    def write(self, rows: DataFrame) -> dict:
        """A new segment of stored rows, dealt by bucket; large buckets may take several files."""
        buckets = min(BUCKETS, max(1, rows.count() // BUCKET_KEYS))
        path = f"{self.folder}/{uuid.uuid4().hex}"
        dealt = rows.select(self.schema.fieldNames()).withColumn("bucket", F.expr(f"cast(pmod(xxhash64(dedup_key), {buckets}) as int)"))
        dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(f"{path}/keys")
        segment = {"path": path, "buckets": buckets, "without": []}
        keys = self._rows(segment).select("dedup_key", "bucket")
        sizes = keys.groupBy("bucket").agg(F.count("*").alias("n"))
        blocks = sizes.select("bucket", F.ceil(F.col("n") / BLOCK_KEYS).cast("int").alias("blocks"), "n")
        # At most one row a bucket.
        held = keys.join(F.broadcast(blocks), "bucket")
        bits = held.select("bucket", "blocks", _block("dedup_key").alias("block"), F.explode(_bits("dedup_key")).alias("bit"))
        filters = bits.groupBy("bucket", "blocks", "block").agg(F.bitmap_construct_agg("bit").alias("filter"))
        filters.withColumn("path", F.lit(path)).write.parquet(f"{path}/filters")
        segment["rows"] = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        return segment

    def _rows(self, segment: dict) -> DataFrame:
        full = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        rows = self.spark.read.schema(full).parquet(f"{segment['path']}/keys")
        if segment["without"]:
            rows = rows.where(~F.col("batch").isin(segment["without"]))
        return rows

    def _union(self, parts: list[DataFrame]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def rows(self, segments: list[dict]) -> DataFrame:
        """All rows, as they were written; one key may have rows in several segments."""
        return self._union([self._rows(s).drop("bucket") for s in segments])

    def hits(self, keys: DataFrame, segments: list[dict]) -> dict[str, list[int]]:
        """Buckets of each segment that can hold one of the keys: at most all of them reach the driver."""
        segments = [s for s in segments if s["rows"]]
        if not segments:
            return {}
        filters = self.spark.read.schema("bucket int, blocks int, block int, filter binary, path string").parquet(*[f"{s['path']}/filters" for s in segments])
        counts = {s["buckets"] for s in segments}
        buckets = F.array(*[F.struct(F.lit(n).alias("of"), F.expr(f"cast(pmod(xxhash64(dedup_key), {n}) as int)").alias("bucket")) for n in sorted(counts)])
        asked = keys.select("dedup_key").where("dedup_key is not null").select("dedup_key", F.explode(buckets).alias("b")).select("dedup_key", "b.*")
        known = self.spark.createDataFrame([(s["path"], s["buckets"]) for s in segments], "path string, of int")
        shapes = filters.groupBy("path", "bucket").agg(F.max("blocks").alias("blocks")).join(F.broadcast(known), "path")
        placed = asked.join(shapes, ["of", "bucket"]).select("dedup_key", "path", "bucket", _block("dedup_key").alias("block"))
        met = placed.join(filters.select("path", "bucket", "block", "filter"), ["path", "bucket", "block"])
        byte = "cast(conv(hex(substring(filter, cast(p div 8 as int) + 1, 1)), 16, 10) as bigint)"
        found = met.withColumn("at", _bits("dedup_key")).where(F.expr(f"forall(at, p -> getbit({byte}, cast(p % 8 as int)) = 1)"))
        out: dict[str, list[int]] = {}
        for row in found.select("path", "bucket").distinct().collect():
            out.setdefault(row["path"], []).append(row["bucket"])
        return out

    def matching(self, keys: DataFrame, segments: list[dict]) -> DataFrame:
        """Rows of the buckets that can hold one of the keys: all rows of those keys, and some of others."""
        wanted = self.hits(keys, segments)
        parts = [self._rows(s).where(F.col("bucket").isin(wanted[s["path"]])).drop("bucket") for s in segments if s["path"] in wanted]
        return self._union(parts)

    def crowded(self, segments: list[dict]) -> list[dict]:
        """FAN or more segments of like size, or none."""
        tiers: dict[int, list[dict]] = {}
        for s in segments:
            tiers.setdefault(int(math.log(max(s["rows"], 1), FAN)), []).append(s)
        return next((t for _, t in sorted(tiers.items()) if len(t) >= FAN), [])

    def merged(self, segments: list[dict]) -> dict:
        """One segment with the rows of several."""
        return self.write(self.merge(self.rows(segments)))
