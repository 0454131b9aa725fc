"""Near duplicates by 64-bit SimHash: the generalised pigeonhole principle with thresholds per fingerprint.

Cut the bits into m parts and give part i a threshold t_i >= -1 with a sum of DISTANCE - m + 1. Two fingerprints that
differ in at most DISTANCE bits then differ in at most t_i bits of some part i, so a fingerprint finds all its
neighbours if it probes every part with t_i >= 0 for the values within t_i bits of its own. Any such thresholds are
right; which are cheap depends on the fingerprint. Bits that go together are put into one part, so that parts are as
independent as they can be and common values are common in few parts. Histograms of the parts' bytes, which count
all distinct fingerprints and have 2,048 entries at any size, estimate the candidates of each part and threshold, and a
dynamic program over the parts allocates each fingerprint's thresholds. The number of parts is the one with the least
expected cost, so parts get wider as the table grows.

Equal fingerprints are one class before anything is probed. A probe joins the index on (part, value) and a candidate
is verified on all 64 bits in the join. Buckets above BUCKET rows, such as those of large groups of near copies, are
not joined: all their fingerprints, probing or indexed, meet at the fingerprints one bit away from them. Two that
differ in at most two bits share such a place, and all that share one differ in at most two. A place has 65 members at
most, so this is exact and linear.

A fingerprint bit is 1 if it is set in over half of the hashes (XXH64, seed 42) of the text's shingles of WIDTH words,
repeats included. Fewer words make one shingle, no words (or a null text) the fingerprint zero, linked like any other.
Rows without doc_id get a fingerprint, are linked with nothing and have a null component. Repeated rows each give a
row; rows of one doc_id with different texts are one document with the links of each. No rows: none. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import LOWER, group_of, signed, spread, texts, words
from postlake.llm.unionfind import components
from postlake.session import materialize

WIDTH = 3
DISTANCE = 2
SEED = 42
#: Rows of a bucket up to which probes are joined with its index.
BUCKET = 64
#: What a probe costs, in candidates.
PROBE = 20
#: Shingles hashed at once, which bounds the working memory of a long text.
SHINGLES_AT_ONCE = 200_000
#: Bytes of the fingerprint in each part, for each number of parts.
PARTS = {2: (4, 4), 3: (3, 3, 2), 4: (2, 2, 2, 2)}

_POPCOUNT = np.array([bin(i).count("1") for i in range(256)])
_AWAY = _POPCOUNT[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


def fingerprints_of(data: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    data = LOWER[data]
    starts, stops, counts = words(data, ends)
    windows = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    first = np.cumsum(counts) - counts
    at = spread(first, windows)
    until = np.minimum(at + width, np.repeat(first + counts, windows))
    owner = group_of(windows)
    data = np.append(data, np.uint8(0x20))
    ones = np.zeros((len(counts), 64), np.int64)
    for low in range(0, len(at), SHINGLES_AT_ONCE):
        part = slice(low, low + SHINGLES_AT_ONCE)
        a, b = at[part][0], until[part][-1]
        sizes = stops[a:b] - starts[a:b] + 1
        places = np.concatenate([[0], np.cumsum(sizes)])
        spaced = data[spread(starts[a:b], sizes)]
        spaced[places[1:] - 1] = 0x20
        raw = spaced.tobytes()
        cuts = zip(places[at[part] - a].tolist(), (places[until[part] - a] - 1).tolist(), strict=True)
        hashes = np.fromiter((xxhash.xxh64_intdigest(raw[x:y], SEED) for x, y in cuts), np.uint64, len(at[part]))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.diff(owner[part], prepend=-1))
        ones[owner[part][heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > windows[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, data, ends in texts(batch.column("text")):
                made = signed(fingerprints_of(data, ends, width))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(made)], ["doc_id", "fp"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, fp long")


def _numbers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)


def together(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j; 64 x 64 whatever the size of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for batch in batches:
            bits = np.unpackbits(_numbers(batch).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64 * 64)), pa.array(total.ravel())], ["cell", "n"])

    out = np.zeros(64 * 64, np.int64)
    for row in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return out.reshape(64, 64)


def bit_groups(both: np.ndarray, n: int) -> np.ndarray:
    """The 64 bits in an order that puts correlated ones next to each other, eight to a group."""
    share = np.diag(both) / max(n, 1)
    spreads = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    linked = np.abs(both / max(n, 1) - np.outer(share, share)) / np.outer(spreads, spreads)
    np.fill_diagonal(linked, 0)
    left, order = set(range(64)), []
    while left:
        rest = sorted(left)
        group = [max(rest, key=lambda i: linked[i, rest].sum())]
        left.remove(group[0])
        while len(group) < 8:
            group.append(max(sorted(left), key=lambda i: linked[i, group].sum()))
            left.remove(group[-1])
        order += group
    return np.array(order)


def bytes_of(fps: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Eight bytes of each fingerprint, with its bits in this order."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits[:, order], axis=1, bitorder="little")


def histograms(fps: DataFrame, order: np.ndarray) -> np.ndarray:
    """How often each of the eight bytes has each value; 2,048 numbers whatever the size of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(8 * 256, np.int64)
        for batch in batches:
            cells = bytes_of(_numbers(batch), order) + 256 * np.arange(8)
            total += np.bincount(cells.ravel(), minlength=8 * 256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(8 * 256)), pa.array(total)], ["cell", "n"])

    out = np.zeros(8 * 256, np.int64)
    for row in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[row["cell"]] = row["n"]
    return out.reshape(8, 256)


def shares(counts: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """[byte, value, d]: share of the fingerprints whose byte differs from the value in d bits."""
    part = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.stack([part @ (_AWAY == d) for d in range(distance + 1)], axis=2)


def _folded(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shares by distance of two independent pieces taken together."""
    out = np.zeros_like(x)
    for d in range(x.shape[1]):
        out[:, d] = sum(x[:, e] * y[:, d - e] for e in range(d + 1))
    return out


def _probes(bits: int, t: int) -> int:
    return sum(1 if d == 0 else int(np.prod([bits - e for e in range(d)])) // (1, 1, 2, 6)[d] for d in range(t + 1))


def costs(near: np.ndarray, n: int, parts: tuple[int, ...]) -> np.ndarray:
    """[fingerprint, part, t + 1]: estimated candidates and probes of a part at threshold t.

    near: [fingerprint, byte, d] as `shares` gives it for the fingerprint's bytes.
    """
    out = np.zeros((near.shape[0], len(parts), near.shape[2] + 1))
    first = 0
    for i, size in enumerate(parts):
        piece = near[:, first]
        for byte in range(first + 1, first + size):
            piece = _folded(piece, near[:, byte])
        first += size
        for t in range(near.shape[2]):
            out[:, i, t + 1] = n * piece[:, : t + 1].sum(axis=1) + PROBE * _probes(8 * size, t)
    return out


def allocate(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds (fingerprint x part) of least cost whose t + 1 add up to DISTANCE + 1, and that cost.

    The dynamic program goes part by part over the units spent so far.
    """
    n, parts, options = cost.shape
    units = options - 1
    best = np.full((n, units + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((parts, n, units + 1), np.int8)
    for i in range(parts):
        now = np.full((n, units + 1), np.inf)
        for spent in range(units + 1):
            for t in range(min(spent, options - 1) + 1):
                value = best[:, spent - t] + cost[:, i, t]
                better = value < now[:, spent]
                now[better, spent] = value[better]
                choice[i, better, spent] = t
        best = now
    thresholds = np.zeros((n, parts), np.int64)
    spent = np.full(n, units)
    for i in reversed(range(parts)):
        chosen = choice[i, np.arange(n), spent].astype(np.int64)
        thresholds[:, i] = chosen - 1
        spent = spent - chosen
    return thresholds, best[:, units]


def best_parts(counts: np.ndarray, n: int) -> tuple[int, ...]:
    """The cut with the least expected cost of a fingerprint, its index rows included."""
    near = shares(counts)
    part = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    expected = np.einsum("bv,bvd->bd", part, near)[None]
    return min(PARTS.values(), key=lambda parts: allocate(costs(expected, n, parts))[1][0] + PROBE * len(parts))


def entries(fps: DataFrame, order: np.ndarray, counts: np.ndarray, n: int, parts: tuple[int, ...]) -> DataFrame:
    """(key, fp, probe, indexed): the parts of every fingerprint, and the values that it probes."""
    near = shares(counts)
    edges = np.cumsum((0, *parts))
    flips = []
    for size in parts:
        bits = range(8 * size)
        flips.append([np.array([sum(1 << b for b in c) for c in combinations(bits, d)], np.uint64) for d in range(DISTANCE + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _numbers(batch)
            for low in range(0, len(fp), 50_000):
                own = fp[low : low + 50_000]
                pieces = bytes_of(own, order)
                thresholds, _ = allocate(costs(near[np.arange(8), pieces], n, parts))
                for i in range(len(parts)):
                    value = np.full(len(own), i, np.uint64)
                    for byte in reversed(range(edges[i], edges[i + 1])):
                        value = (value << np.uint64(8)) | pieces[:, byte].astype(np.uint64)
                    found = [(value, own, thresholds[:, i] >= 0, True)]
                    for d in range(1, DISTANCE + 1):
                        far = thresholds[:, i] >= d
                        masks = flips[i][d]
                        found.append(((value[far][:, None] ^ masks).ravel(), np.repeat(own[far], len(masks)), True, False))
                    for key, owner, probe, indexed in found:
                        columns = [signed(key), signed(owner), np.broadcast_to(probe, len(key)), np.broadcast_to(indexed, len(key))]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "fp", "probe", "indexed"])

    return fps.select("fp").mapInArrow(run, "key long, fp long, probe boolean, indexed boolean")


def _met(fps: DataFrame) -> DataFrame:
    """Links of all fingerprints within two bits of each other, by the places one bit away from both."""
    masks = F.array(*[F.lit(0).cast("long"), *[F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(64)]])
    places = fps.select("fp", F.explode(masks).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("place"))
    met = places.groupBy("place").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a <> b").distinct()


def links(fps: DataFrame) -> DataFrame:
    """(a, b) that connect all distinct fingerprints `fp` with at most DISTANCE differing bits."""
    fps = fps.select("fp")
    n = fps.count()
    order = bit_groups(together(fps), n)
    counts = histograms(fps, order)
    made = materialize(entries(fps, order, counts, n, best_parts(counts, n)), "entries")
    own = F.col("probe") & F.col("indexed")
    sizes = made.groupBy("key").agg(F.count("*").alias("rows"), F.count_if("probe").alias("p"), F.count_if("indexed").alias("x"), F.count_if(own).alias("both"))
    # A bucket needs a probe and another fingerprint of the index.
    busy = materialize(sizes.filter("p > 0 and x > 0 and p + x - both > 1"), "buckets")
    few = made.join(busy.filter(F.col("rows") <= BUCKET).select("key"), "key")
    left = few.filter("probe").select("key", F.col("fp").alias("a"))
    right = few.filter("indexed").select("key", F.col("fp").alias("b"))
    away = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = left.join(right, "key").filter((F.col("a") != F.col("b")) & (away <= DISTANCE))
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    hot = made.join(busy.filter(F.col("rows") > BUCKET).select("key"), "key").select("fp").distinct()
    return pairs.unionByName(_met(hot))


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Documents whose fingerprints differ in at most DISTANCE bits are linked; a component's id is its smallest doc_id.
    """
    sketch = materialize(fingerprints(docs, width), "fingerprints")
    real = sketch.filter("doc_id is not null")
    classes = materialize(real.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    # An id with several texts joins their classes.
    several = real.groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("y")).filter("b <> y").select("doc_id", "b")
    bridges = real.join(several, "doc_id").filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    groups = components(materialize(links(classes).unionByName(bridges), "links"))
    named = classes.join(groups.withColumnRenamed("id", "fp"), "fp", "left").withColumn("g", F.coalesce("component", "fp"))
    named = materialize(named.select("fp", "least", "g"), "named")
    heads = named.groupBy("g").agg(F.min("least").alias("component_id"))
    out = sketch.join(named.join(heads, "g").select("fp", "component_id"), "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", text.alias("fingerprint"), component.alias("component_id"))
