"""Exact top-k by inner product with the no-random-access algorithm.

Vectors are dealt to cells by their nearest pivot, large cells to blocks of about BLOCK_ROWS, and queries to blocks of
QUERY_ROWS; a pair of blocks is one group, so the work is spread however large either side is. A query first reads the
likeliest cells, whose k-th score is a threshold; of the others it reads those that can hold a score as large, by the
extremes of the cell's components and by its radius around the pivot. Inside a group each dimension is a list sorted by
value. A query reads its lists in step from the end that its sign prefers; a vector's lower
bound takes the list's worst value for unread dimensions, its upper bound the last value read. Reading
stops when no vector outside the best k by lower bound can exceed the k-th of them; the scores of those
that remain in question are then resolved. The lists of all groups of a query meet in a rank filter.

Vectors that are null or empty, or hold null or non-finite components, take no part, and a query only meets
vectors of its own length. Equal scores rank by id; repeated ids each count. No queries or vectors: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.session import materialize

BLOCK_ROWS = 8_192
QUERY_ROWS = 512
MAX_PARTITIONS = 20_000
#: Cells for each block that the vectors fill, and of all at most. Fewer vectors than a block are one cell.
CELLS_PER_BLOCK = 4
MAX_CELLS = 256
#: How deep the lists are read before the bounds are compared, in sixteenths, and rows in question whose
#: scores are then resolved instead of reading on.
DEPTHS = (2, 4, 8, 12, 14, 15, 16)
RESOLVED = 256

OUT = "query_id long, vec_id long, score long"


def whole_parts(vector: Column, factor: int = 64) -> Column:
    """floor(factor * x) of every component as int, or null if the vector takes no part."""
    limit = F.lit(float("inf"))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == limit))
    made = F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, made)


def no_random_access(x: np.ndarray, q: np.ndarray, k: int, own: np.ndarray, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, rows, scores) with the k best rows of x for each row of q, ties with the k-th among them.

    own: queries x rows, what takes no part. wanted: scores below it are not asked for. All numbers are whole. The lists are read from both ends in
    step: queries take the upper end of a dimension where they are positive and the lower where they are
    negative, so one reading serves all of them.
    """
    n, dims = x.shape
    reach = dims * float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0))
    # Sums are whole and stay below the precision of the type, so they are exact.
    kind = np.float32 if reach < 1 << 24 else np.float64
    x, q = x.astype(kind), q.astype(kind)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    lists = np.argsort(x, axis=0)
    columns = np.arange(dims)
    least, most = x[lists[0], columns], x[lists[-1], columns]
    top, bottom = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
    waiting = np.arange(len(q))
    k, read = min(k, n), 0
    for depth in sorted({-(-n * part // 16) for part in DEPTHS}):
        top[lists[n - depth : n - read], columns] = True
        bottom[lists[read:depth], columns] = True
        read = depth
        p, m, out = plus[waiting], minus[waiting], own[waiting]
        lower = p @ np.where(top, x, least).T + m @ np.where(bottom, x, most).T
        lower[out] = -np.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k]
        if wanted is not None:
            kth = np.maximum(kth, wanted[waiting])
        if depth < n:
            upper_end, lower_end = x[lists[n - depth], columns], x[lists[depth - 1], columns]
            # Rows that no list has shown yet, and rows that some have.
            safe = p @ upper_end + m @ lower_end < kth
            open_ = p @ np.where(top, x, upper_end).T + m @ np.where(bottom, x, lower_end).T >= kth[:, None]
            done = safe & (open_.sum(axis=1) <= RESOLVED)
        else:
            open_, done = lower >= kth[:, None], np.ones(len(waiting), bool)
        open_ &= ~out
        for i in np.flatnonzero(done):
            rows = np.flatnonzero(open_[i])
            yield int(waiting[i]), rows, np.rint(x[rows] @ q[waiting[i]]).astype(np.int64)
        waiting = waiting[~done]
        if not len(waiting):
            return


def _search(queries: pd.DataFrame, base: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    lengths = base["v"].map(len)
    for length, asked in queries.groupby(queries["v"].map(len)):
        members = base[lengths == length]
        if not len(members):
            continue
        names, ids = members["vec_id"].to_numpy(), asked["vec_id"].to_numpy()
        x, q = np.stack(members["v"].to_list()), np.stack(asked["v"].to_list())
        least = asked["least"].to_numpy()
        for i, rows, scores in no_random_access(x, q, k, names[None, :] == ids[:, None], least):
            rows, scores = rows[scores >= least[i]], scores[scores >= least[i]]
            best = np.lexsort((names[rows], -scores))[:k]
            yield pd.DataFrame({"query_id": ids[i], "vec_id": names[rows][best], "score": scores[best]})


class Cells:
    """What is known of the cells that vectors lie in: at most MAX_CELLS rows, whatever the number of vectors."""

    def __init__(self, stats: list[dict], pivots: dict[int, np.ndarray]):
        self.rows = {s["cell"]: s["rows"] for s in stats}
        held = {s["cell"]: s for s in stats if s["cell"] >= 0}
        self.lengths: dict[int, tuple[np.ndarray, ...]] = {}  # cells, pivots, extremes and radius by vector length
        for length in {len(p) for p in pivots.values()}:
            names = [c for c, p in pivots.items() if len(p) == length and (c in held or not stats)]
            if names:
                known = [held[c] for c in names] if stats else []
                low, high = (np.array([s[e] for s in known], float) for e in ("low", "high"))
                self.lengths[length] = (np.array(names), np.stack([pivots[c] for c in names]), low, high, np.array([s["radius"] for s in known]))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cells of the nearest pivots of vectors of one length, and the distances; -1 without a pivot."""
        n, length = vectors.shape
        if length not in self.lengths:
            return np.full(n, -1), np.zeros(n)
        names, pivots, *_ = self.lengths[length]
        best = np.argmin((pivots * pivots).sum(axis=1) - 2 * vectors @ pivots.T, axis=1)
        return names[best], np.sqrt(((vectors - pivots[best]) ** 2).sum(axis=1))

    def bounds(self, q: np.ndarray) -> list[tuple[float, float, int]]:
        """(likely score, greatest possible score, cell) of the cells that can hold vectors of the query's length."""
        out = [(-math.inf, math.inf, -1)] if -1 in self.rows else []
        if len(q) in self.lengths:
            names, pivots, low, high, radius = self.lengths[len(q)]
            likely = pivots @ q
            box = np.maximum(q * low, q * high).sum(axis=1)
            most = np.minimum(box, likely + math.sqrt(float(q @ q)) * radius)
            most += 1e-6 * np.maximum(1.0, np.abs(most))
            out += zip(likely.tolist(), most.tolist(), names.tolist(), strict=True)
        return sorted(out, reverse=True)

    def first(self, q: np.ndarray, k: int) -> list[int]:
        """The likeliest cells that hold more than k vectors together."""
        chosen, held = [], 0
        for _, _, c in self.bounds(q):
            if held > k:
                break
            chosen.append(c)
            held += self.rows[c]
        return chosen


def _vectors(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.asarray(v, float) for v in rows["v"]]


def _dealt(base: DataFrame) -> tuple[DataFrame, Cells]:
    """`base` with the cell of each row, and the cells.

    Pivots are a bounded sample; they decide how much is read, never what is found.
    """
    blocks = math.ceil(base.count() / BLOCK_ROWS)
    number = min(MAX_CELLS, CELLS_PER_BLOCK * blocks) if blocks > 1 else 1
    drawn = base.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(number).collect()
    pivots = {i: np.array(r["v"], float) for i, r in enumerate(drawn)}
    empty = Cells([], pivots)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for _, part in rows.groupby(rows["v"].map(len)):
                cell, away = empty.nearest(np.stack(part["v"].to_list()).astype(float))
                yield part.assign(cell=cell.astype(np.int32), away=away)

    placed = materialize(base.mapInPandas(place, "vec_id long, v array<long>, cell int, away double"), "cells")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for cell, held in rows.groupby("cell"):
                x = np.stack(held["v"].to_list()) if cell >= 0 else np.zeros((1, 0))
                yield pd.DataFrame({"cell": [cell], "rows": [len(held)], "radius": [held["away"].max()], "low": [x.min(axis=0)], "high": [x.max(axis=0)]})

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = np.stack(rows["low"].to_list()).min(axis=0), np.stack(rows["high"].to_list()).max(axis=0)
        return pd.DataFrame({"cell": [rows["cell"].iat[0]], "rows": [rows["rows"].sum()], "radius": [rows["radius"].max()], "low": [low], "high": [high]})

    shape = "cell int, rows long, radius double, low array<long>, high array<long>"
    stats = placed.mapInPandas(measure, shape).groupBy("cell").applyInPandas(combine, shape).collect()
    return placed, Cells([s.asDict() for s in stats], pivots)


_ASKED = "vec_id long, v array<long>, cell int, least double"


def _first(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(vec_id, v, cell, least): the queries at the cells that they read first; every score is asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            chosen = [cells.first(v, k) for v in _vectors(rows)]
            at = np.repeat(np.arange(len(rows)), list(map(len, chosen)))
            yield rows[["vec_id", "v"]].iloc[at].assign(cell=np.array([c for x in chosen for c in x], np.int32), least=-math.inf)

    return queries.mapInPandas(run, _ASKED)


def _rest(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """The same for the other cells that can hold a score of at least `least`, the k-th so far; only these are asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            chosen = []
            for v, least in zip(_vectors(rows), rows["least"], strict=True):
                done = set(cells.first(v, k))
                chosen.append([c for _, most, c in cells.bounds(v) if c not in done and most >= least])
            at = np.repeat(np.arange(len(rows)), list(map(len, chosen)))
            yield rows[["vec_id", "v", "least"]].iloc[at].assign(cell=np.array([c for x in chosen for c in x], np.int32))[["vec_id", "v", "cell", "least"]]

    return queries.fillna(-math.inf, ["least"]).mapInPandas(run, _ASKED)


def _met(asked: DataFrame, placed: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block for the queries at its cell."""
    counts = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
    shapes = [(c, math.ceil(cells.rows[c] / BLOCK_ROWS), math.ceil(n / QUERY_ROWS)) for c, n in counts.items()]
    if not shapes:
        return asked.sparkSession.createDataFrame([], OUT)
    shape = F.broadcast(asked.sparkSession.createDataFrame(shapes, "cell int, blocks int, rounds int"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(shape, "cell").withColumn("q", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("rounds")).cast("int")).withColumn("b", numbers("blocks"))
    right = placed.join(shape, "cell").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("q", numbers("rounds"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = list(_search(a, b, k))
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return pd.concat(found, ignore_index=True)

    # Groups are few and heavy: far more partitions than groups keep them from meeting in one task.
    parts = min(4 * sum(x * y for _, x, y in shapes), MAX_PARTITIONS)
    left, right = (x.drop("away", "blocks", "rounds").repartition(parts, "cell", "q", "b") for x in (left, right))
    return left.groupBy("cell", "q", "b").cogroup(right.groupBy("cell", "q", "b")).applyInPandas(run, OUT)


def _ranked(near: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(base: DataFrame, queries: DataFrame, k: int = 20, vector: str = "v") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k best rows of `base`, itself left out by id.

    Both sides have vec_id and `vector`, an array of whole numbers. Queries of one id share one list.
    """
    base = base.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<long>").alias("v")).dropna()
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<long>").alias("v")).dropna()
    placed, cells = _dealt(base)
    near = _met(_first(queries, cells, k), placed, cells, k)
    if len(cells.rows) > 1:
        near = materialize(_ranked(near, k), "near")
        least = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("least"))
        rest = materialize(_rest(queries.join(least, "vec_id", "left"), cells, k), "rest")
        near = near.drop("rank").unionByName(_met(rest, placed, cells, k))
    return _ranked(near, k).select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, b.vec_id as vec_id,
    list_sum(list_transform(list_zip(q.v, b.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v b on q.vec_id <> b.vec_id and q.vec_id % 20 = 0 and len(q.v) = len(b.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""
