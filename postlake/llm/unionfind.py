"""Connected components of a table of links: union-find in tasks, stars between them.

Every task first joins what its own links connect, so a small table is settled at once. What spans tasks is
settled by two alternating steps: the large step hangs each larger neighbour of a node on the least
neighbour, the small step hangs the smaller neighbours and the node itself there. All steps keep the
components, and the links end as stars around the least id, in a logarithmic number of rounds for links
of any shape. Links stay in tables; the driver only learns whether they are stars yet. Minima are
aggregated before they are joined, so a node with very many links is no single task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.session import materialize

#: Links that a task joins at once, which bounds its memory.
CHUNK = 1_000_000


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 the least node that the links a-b connect them to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        now = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(now, at, low)
        while not np.array_equal(now[now], now):
            now = now[now]
        if np.array_equal(now, label):
            return label
        label = now


def _contracted(links: DataFrame) -> DataFrame:
    """Links of each task as stars around the least ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            pairs = np.concatenate(held)
            held.clear()
            ids, index = np.unique(pairs, return_inverse=True)
            index = index.reshape(pairs.shape)
            least = ids[least_labels(index[:, 0], index[:, 1], len(ids))]
            leaf = least != ids
            return pa.RecordBatch.from_arrays([pa.array(ids[leaf]), pa.array(least[leaf])], ["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()], axis=1))
            if sum(map(len, held)) >= CHUNK:
                yield flush()
        if held:
            yield flush()

    return links.mapInArrow(run, "a long, b long")


def _is_star(links: DataFrame) -> bool:
    """Whether every node is either a centre or has one link."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up")))).alias("e"))
    seen = ends.select("e.*").groupBy("id").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return seen.filter("up > 1 or (up = 1 and least = 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id that has a link; component is the least id reachable.

    links: (a, b) in any direction, repeated or not. Loops are ignored. No links: no rows.
    """
    plain = links.filter("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    # Links are contracted as they are read back: a file split holds far more of them than a shuffle partition.
    now = materialize(_contracted(materialize(plain, "links")).distinct(), "star")
    while not _is_star(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("p")
        small = large.join(least, "a").select(pairs).select(F.col("p.a").alias("a"), F.col("p.m").alias("b"))
        held = materialize(small.filter("a <> b"), "links")
        now = materialize(_contracted(held).distinct(), "star")
    ends = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
