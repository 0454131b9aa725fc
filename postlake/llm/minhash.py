"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find.

Each shingle of a document draws, one after the other, the entries of its own random permutation of the
signature's components; its j-th entry offers the value j + a random fraction. A component keeps the least
offer. Since no offer of a later round is below j, a document stops as soon as all components are below the
next round: large sets need one or two rounds, and the components of a signature are spread more evenly
than independent hashes are. Two sets agree in a component with their Jaccard similarity as probability.

Documents with equal shingle sets form a class and only its smallest id goes on, so thousands of copies
cost one signature lookup. Bands of the signature that agree make candidates. A bucket does not emit its
pairs: its members are compared to one pivot and, where a bucket still holds several groups, to three more.
Members of different groups that are left are compared with each other: by joins in small buckets, in tasks
over pairs of blocks in large ones, which return links, not pairs. So every candidate that could join two
groups is compared on the full sets.

With BANDS bands of ROWS rows a link at the threshold of 0.8 is missed with a probability of 4e-6, a
stronger one less.

Rows without doc_id or words are linked with nothing. Repeated rows each give a row; rows of one doc_id with
different texts count as one document that has the links of each. No rows: none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import mix, signed, spread, texts
from postlake.llm.shingles import shingle_sets
from postlake.llm.unionfind import components, least_labels
from postlake.session import materialize

ROWS = 5
BANDS = 32
#: Members of a bucket up to which pairs of different groups are compared by joins, and members of a block
#: of a larger one.
SMALL_BUCKET = 16
BLOCK = 1_024

_STEP = np.uint64(0xA0761D6478BD642F)
_OTHER = np.uint64(0xE7037ED1A0B428DB)


def super_minhash(elements: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Signatures (texts x size, round * 2**32 + fraction) of the sets that `counts` cuts `elements` into.

    size is at most 256. An empty set keeps the largest number in every component.
    """
    docs = len(counts)
    out = np.full((docs, size), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(docs), counts)
    left = elements
    permuted: np.ndarray | None = None
    for j in range(size):
        if not len(left):
            break
        drawn = mix(left ^ (np.uint64(int(_STEP) * (j + 1) % (1 << 64))))
        place = (j + (drawn >> np.uint64(32)) % np.uint64(size - j)).astype(np.int64)
        if permuted is None:
            slot = place
        else:
            rows = np.arange(len(left))
            slot = permuted[rows, place].astype(np.int64)
            permuted[rows, place] = permuted[:, j]
            permuted[:, j] = slot
        offer = np.uint64(j << 32) | (drawn & np.uint64(0xFFFFFFFF))
        np.minimum.at(flat, owner * size + slot, offer)
        names, index = np.unique(owner, return_inverse=True)
        going = (out[names].max(axis=1) >= np.uint64((j + 1) << 32))[index]
        if permuted is None:
            left, owner, place = left[going], owner[going], place[going]
            permuted = np.tile(np.arange(size, dtype=np.uint8), (len(left), 1))
            permuted[np.arange(len(left)), place] = 0
            permuted[:, 0] = place
        else:
            left, owner, permuted = left[going], owner[going], permuted[going]
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signatures.reshape(len(signatures), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for r in range(rows):
        key = mix(key * _OTHER + parts[:, :, r])
    return key


def sketches(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n, c1, c2, bands): size, 128-bit digest and band keys of each document's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, data, ends in texts(batch.column("text")):
                sets, counts = shingle_sets(data, ends, width)
                keys = signed(band_keys(super_minhash(sets, counts, bands * rows), bands, rows))
                sums = np.zeros((2, b - a), np.uint64)
                some = np.flatnonzero(counts)
                if len(some):
                    heads = (np.cumsum(counts) - counts)[some]
                    sums[0, some] = np.add.reduceat(mix(sets ^ _STEP), heads)
                    sums[1, some] = np.add.reduceat(mix(sets ^ _OTHER), heads)
                sizes = np.where(counts > 0, bands, 0)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[counts > 0].reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(counts), pa.array(signed(sums[0])), pa.array(signed(sums[1])), lists],
                    ["doc_id", "n", "c1", "c2", "bands"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n long, c1 long, c2 long, bands array<long>")


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """(id, s): the whole shingle set of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, data, ends in texts(batch.column("text")):
                sets, counts = shingle_sets(data, ends, width)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(sets)))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), lists], ["id", "s"])

    return docs.mapInArrow(run, "id long, s array<long>")


def _alike(x: Column, y: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the similarity at all."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    close = both * 100 >= (F.size("sa") + F.size("sb") - both) * percent
    return pairs.join(left, "a").join(right, "b").filter(close).select("a", "b")


def _pivots(members: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of each member and its bucket's pivot, the least id by a mix that depends on the turn."""
    order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
    pivot = members.groupBy("key").agg(F.min(F.struct(order.alias("o"), "id", "n")).alias("p"))
    joined = members.join(pivot, "key").filter((F.col("id") != F.col("p.id")) & _alike(F.col("n"), F.col("p.n"), percent))
    low, high = F.least("id", "p.id"), F.greatest("id", "p.id")
    return joined.select(high.alias("a"), low.alias("b")).distinct()


def _more_pivots(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs with three more pivots of each bucket."""
    found = [_pivots(rest, turn, percent) for turn in (1, 2, 3)]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


def _few(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs of different groups in small buckets."""
    few = rest.filter(F.col("size") <= SMALL_BUCKET)
    other = few.select("key", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("g").alias("g2"))
    pairs = few.join(other, "key").filter((F.col("g") < F.col("g2")) & _alike(F.col("n"), F.col("n2"), percent))
    return pairs.select(F.greatest("id", "id2").alias("a"), F.least("id", "id2").alias("b")).distinct()


def overlaps(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets that `sizes` cuts `tokens` into."""
    m = len(sizes)
    owner = np.repeat(np.arange(m), sizes)
    _, index, count = np.unique(tokens, return_inverse=True, return_counts=True)
    out = np.zeros((m, m), np.float32)
    frequent = np.flatnonzero(count > max(16, m // 8))
    column = np.full(len(count), -1)
    for at in range(0, len(frequent), 2_048):
        part = frequent[at : at + 2_048]
        column[:] = -1
        column[part] = np.arange(len(part))
        have = column[index] >= 0
        dense = np.zeros((m, len(part)), np.float32)
        dense[owner[have], column[index[have]]] = 1
        out += dense @ dense.T
    rare = (count > 1) & (count <= max(16, m // 8))
    chosen = np.flatnonzero(rare[index])
    chosen = chosen[np.argsort(index[chosen], kind="stable")]
    lengths = count[np.flatnonzero(rare)]
    starts = np.cumsum(lengths) - lengths
    for c in np.unique(lengths):
        lists = owner[chosen[spread(starts[lengths == c], np.full((lengths == c).sum(), c))]].reshape(-1, c)
        x, y = np.triu_indices(c, 1)
        for at in range(0, len(lists), max(1, 2_000_000 // max(1, len(x)))):
            part = lists[at : at + max(1, 2_000_000 // max(1, len(x)))]
            pairs = (part[:, x] * m + part[:, y]).ravel()
            more = np.bincount(pairs, minlength=m * m).reshape(m, m).astype(np.float32)
            out += more + more.T
    return out


def _blocks(many: DataFrame) -> DataFrame:
    """Members with the block of their bucket that they are in: large groups have blocks of their own."""
    groups = many.groupBy("key", "g").agg(F.count("*").alias("held"))
    large = F.col("held") > BLOCK // 2
    few = groups.groupBy("key").agg(F.sum(F.when(~large, F.col("held")).otherwise(0)).alias("others"))
    sized = groups.withColumn("large", large).join(few, "key")
    parts = F.greatest(F.lit(1), F.ceil(F.when(F.col("large"), F.col("held")).otherwise(F.col("others")) / BLOCK)).cast("int")
    sized = sized.select("key", "g", F.when(F.col("large"), F.col("g")).alias("of"), parts.alias("parts"))
    no = F.pmod(F.xxhash64("id", F.lit(17)), F.col("parts")).cast("int")
    return many.join(sized, ["key", "g"]).withColumn("block", F.struct("of", no.alias("no"))).drop("of", "parts")


def _many(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different groups of large buckets, as stars around the least id that they connect.

    Members are dealt to blocks, and two blocks are compared on the full sets in one task unless both hold one group
    only, the same. So a group is never compared with itself, and a bucket of one large group and some others costs as
    many tasks as the group has blocks. Nothing is emitted for a pair; a task returns at most one link per member.
    """
    dealt = _blocks(rest.filter(F.col("size") > SMALL_BUCKET).select("key", "id", "g"))
    dealt = materialize(dealt, "blocks")
    blocks = dealt.select("key", "block").distinct()
    other = blocks.withColumnRenamed("block", "other")
    same = F.col("block.of").isNotNull() & F.col("block.of").eqNullSafe(F.col("other.of"))
    low = F.struct(F.coalesce("block.of", F.lit(-1)), F.col("block.of").isNull(), "block.no")
    high = F.struct(F.coalesce("other.of", F.lit(-1)), F.col("other.of").isNull(), "other.no")
    pairs = blocks.join(other, "key").filter((low <= high) & ~same)
    pairs = materialize(pairs.withColumn("pair", F.xxhash64("key", "block", "other")), "block_pairs")
    first = dealt.join(pairs.select("key", "block", "pair"), ["key", "block"]).withColumn("side", F.lit(0))
    apart = pairs.filter(~F.col("block").eqNullSafe(F.col("other")))
    second = dealt.join(apart.select("key", F.col("other").alias("block"), "pair"), ["key", "block"]).withColumn("side", F.lit(1))
    met = first.unionByName(second).select("key", "pair", "side", "id", "g").join(sets, "id")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ids, g, side = (group[c].to_numpy() for c in ("id", "g", "side"))
        n = np.fromiter(map(len, group["s"]), np.int64, len(group))
        both = overlaps(np.concatenate(group["s"].to_list()), n)
        close = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        close &= g[:, None] != g[None, :]
        if side.any():
            close &= side[:, None] != side[None, :]
        x, y = np.nonzero(np.triu(close, 1))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        least = ids[order][least_labels(place[x], place[y], len(ids))]
        leaf = least != ids[order]
        return pd.DataFrame({"a": ids[order][leaf], "b": least[leaf]})

    return met.groupBy("key", "pair").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Documents with a Jaccard similarity of at least `percent` / 100 of their shingle sets are linked; a
    component's id is its smallest doc_id, and the document with that id is kept. Rows without doc_id keep
    a null component and are kept.
    """
    sketch = materialize(sketches(docs, width, bands, rows), "sketches")
    real = sketch.filter("doc_id is not null and n > 0")
    classes = materialize(real.groupBy("n", "c1", "c2").agg(F.min("doc_id").alias("id")), "classes")
    # An id with several texts joins their classes, also those that another id stands for.
    kind = F.struct("n", "c1", "c2")
    several = real.groupBy("doc_id").agg(F.min(kind).alias("x"), F.max(kind).alias("y")).filter("x <> y").select("doc_id")
    mixed = real.select("doc_id", "n", "c1", "c2").join(materialize(several, "several"), "doc_id", "left_semi").distinct()
    bridges = mixed.join(classes, ["n", "c1", "c2"]).filter("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    reps = real.join(classes.select(F.col("id").alias("doc_id"), "n", "c1", "c2"), ["doc_id", "n", "c1", "c2"], "left_semi")
    keyed = reps.select(F.col("doc_id").alias("id"), "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    members = materialize(keyed.join(shared, "key").distinct(), "members")

    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = wanted.join(found, "doc_id")
    sets = materialize(sets_of(own, width), "sets")

    seen = _pivots(members, 0, percent)
    links = materialize(_verified(seen, sets, percent).select("a", "b").unionByName(bridges), "links")
    groups = components(links)
    for last in (False, True):
        named = members.join(groups, "id", "left").withColumn("g", F.coalesce("component", "id"))
        mixed = named.groupBy("key").agg(F.min("g").alias("x"), F.max("g").alias("y"), F.count("*").alias("size"))
        mixed = mixed.filter("x < y").select("key", "size")
        rest = materialize(named.join(mixed, "key").select("key", "size", "id", "n", "g"), "rest")
        pairs = _few(rest, percent) if last else _more_pivots(rest, percent)
        pairs = materialize(pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        more = _verified(pairs, sets, percent)
        if last:
            more = more.unionByName(_many(rest, sets, percent))
        more = materialize(more, "links")
        seen = seen.unionByName(pairs)
        if not more.isEmpty():
            links = links.unionByName(more)
            groups = components(links)

    named = classes.join(groups, "id", "left").select("n", "c1", "c2", F.coalesce("component", "id").alias("g"))
    out = sketch.select("doc_id", "n", "c1", "c2").join(named, ["n", "c1", "c2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("g", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


SQL = r"""
with recursive d as (select doc_id, text from documents where doc_id is not null),
w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from w),
n as (select doc_id, len(s)::bigint as n from s),
x as (select doc_id, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n na on na.doc_id = p.a join n nb on nb.doc_id = p.b
  where 100 * i >= 80 * (na.n + nb.n - i)),
e as (select a, b from l union all select b, a from l),
c as (select doc_id, doc_id as r from n union select e.b, c.r from c join e on e.a = c.doc_id)
select c.doc_id, any_value(n.n) as n_shingles, min(c.r) as component_id, c.doc_id = min(c.r) as kept
from c join n on n.doc_id = c.doc_id group by c.doc_id
"""
