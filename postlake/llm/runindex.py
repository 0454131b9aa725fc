"""Exact removal of repeated passages with a run-length index of the repetitive part of a corpus.

A byte goes if a string of `length` bytes that covers it also starts anywhere else.

1. Every string of `length` bytes is assigned to its anchor, the K-byte piece in it with the least hash (the
   leftmost such). Equal strings have equal anchors, so only anchors that occur twice can hold repeats; all
   other text, usually most of it, is left out. The strings of one anchor start side by side and together
   form its context.
2. Where all contexts of an anchor are equal, or a context has an equal, all its strings repeat. This
   settles the inside of copies, however many there are.
3. The differing contexts of an anchor go to one task. Equal strings stand at the same distance from their
   anchor, so a block of strings whose core is alone at its distance is left out; the rest is indexed there:
   suffix order, Burrows-Wheeler transform, its runs, and the order's entries at both ends of each run. The
   matching statistics of the text against the rest are exact at run ends and lose one per byte in between,
   so they are streamed in text order from the samples. Positions with `length` or more mark a repeat.
4. An anchor with more than GROUP differing contexts, such as the edge of a passage that very many
   documents share, would not fit a task: its strings are counted by hash in shuffles instead, first in
   blocks, then in smaller ones, and one by one only where these are neither unique nor repeated as a whole.

Hashes are 64 bits wide and compared in pairs (anchor and context, or anchor and string).

Null texts count as empty. Repeated rows are each other's copies. Texts shorter than `length` stay whole.
No rows: none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import flat, mix, own_column, powers, prefix_hash, signed, slices, span_hash, spread
from postlake.session import materialize

LENGTH = 200
K = 32
#: Differing contexts of one anchor that a task indexes; more are counted in a shuffle.
GROUP = 1_000
#: Strings of a context that are counted as one block first, and next; the first is a multiple of the second.
BLOCK, FINE = 16, 4
#: Bytes indexed at once, and window starts worked on at once.
INDEX_BYTES = 600_000
PIECE = 250_000
#: Bytes of text whose contexts are cut out at once.
CONTEXT_BYTES = 2_000_000

#: Bits of an order's entry that hold the place, and a factor that spreads the hash over the others.
_PLACE = np.uint64((1 << 24) - 1)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)

_ID = "row_id long, row_hash long"
_KEYS = ["row_id", "row_hash"]


def _rows(docs: DataFrame) -> DataFrame:
    """(row_id, row_hash, text): equal rows have equal keys, and are each other's copies anyway."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(number.alias("row_id"), F.xxhash64(text, F.lit(3)).alias("row_hash"), text.alias("text"))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by doubling the width. `x` is overwritten."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:], out=x[:-have])
        have *= 2
    return np.minimum(x[: len(x) - width + have], x[width - have :]) if have < width else x


def _flat_runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first, last, anchor hash, context hash) of runs of strings with the same anchor.

    Places count from the start of the row. The strings of a run start at first..last and together cover
    first..last + length; strings that reach over the end of a text are none.
    """
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (np.uint64,) * 2)
    prefix = prefix_hash(data)
    pieces = len(data) - K + 1
    order = prefix[K:] - prefix[:pieces]
    order *= powers(pieces)[1]
    # A few steps of `mix` are enough to choose by; the low bits hold the place, so equal entries are one place.
    order ^= order >> np.uint64(32)
    order *= _SPREAD
    order &= ~_PLACE
    order |= np.arange(pieces, dtype=np.uint64)
    least = _sliding_min(order, length - K + 1)
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    # A run ends with its text's last string, and starts with its first.
    edges = np.concatenate([ends[:-1], ends[1:] - length + 1])
    new[edges[(edges >= 0) & (edges < len(new))]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    row = np.searchsorted(ends, first, "right") - 1
    inside = first + length <= ends[row + 1]
    first, last, row = first[inside], last[inside], row[inside]
    anchor = (least[first] & _PLACE).astype(np.int64)
    base = ends[row]
    context = span_hash(prefix, first, last + length)
    return row, anchor - base, first - base, last - base, span_hash(prefix, anchor, anchor + K), context


def _pieces(data: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, offset in the row, bytes, ends): groups of short texts, or overlapping parts of a long one."""
    for a, b in slices(ends, PIECE):
        lo, hi = int(ends[a]), int(ends[b])
        if b - a == 1 and hi - lo > PIECE:
            for at in range(lo, max(lo + 1, hi - length + 1), PIECE):
                stop = min(hi, at + PIECE + length - 1)
                yield a, at - lo, data[at:stop], np.array([0, stop - at])
        else:
            yield a, 0, data[lo:hi], ends[a : b + 1] - lo


def anchors(rows: DataFrame, length: int) -> DataFrame:
    """(row_id, row_hash, at, shape, h, ctx): anchors of all texts.

    at: first string's start; shape: the anchor's distance from it and how many more strings there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy() for c in _KEYS)
            data, ends = flat(batch.column("text"))
            for a, offset, part, part_ends in _pieces(data, ends, length):
                row, anchor, first, last, h, ctx = _flat_runs(part, part_ends, length)
                shape = (anchor - first) * 4096 + (last - first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids[a + row], hashes[a + row], first + offset, shape.astype(np.int32), signed(h), signed(ctx))],
                    [*_KEYS, "at", "shape", "h", "ctx"],
                )

    return rows.mapInArrow(run, f"{_ID}, at long, shape int, h long, ctx long")


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of some texts, with samples at both ends of each run.

    starts, stops: where each text lies in `data`; every text ends with a sign of its own that is less than
    all bytes. run_first, run_last: first and last rank of each run; head, tail: their text positions.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        self.stop = np.repeat(stops, stops - starts)
        text = np.repeat(np.arange(len(starts)), stops - starts)
        n = len(data)
        at = np.arange(n)
        rest = self.stop - at
        key = data.astype(np.int64) + 1
        for width, used in ((1, 1), (2, 2), (4, 3)):  # one sign, two, four, seven
            after = np.zeros(n, np.int64)
            after[:-width] = key[width:] >> 9 * (width - used)
            after[rest <= width] = 0
            key = key << 9 * used | after
        self.levels: list[tuple[int, np.ndarray]] = []
        order = np.argsort(key)
        ranked = key[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        slots, rank = at, np.empty(n, np.int64)
        members, step = order, 7
        while True:
            # A group's rank is the first of its places in the order; only groups of two or more go on.
            rank[members] = np.maximum.accumulate(np.where(new, slots, 0))
            self.levels.append((step, rank))
            going = ~(new & np.append(new[1:], True))
            if not going.any():
                break
            slots, members = slots[going], members[going]
            place = np.minimum(members + step, n - 1)
            after = np.where(step < rest[members], rank[place] + len(starts), len(starts) - 1 - text[members])
            key = rank[members] * (n + len(starts) + 1) + after
            sort = np.argsort(key)
            members, key = members[sort], key[sort]
            order[slots] = members
            new = np.append(True, key[1:] != key[:-1])
            rank = rank.copy()
            step *= 2
        self.data, self.order, self.rank = data, order, rank
        before = np.where(at > starts[text], data[np.maximum(at - 1, 0)].astype(np.int64), -1 - text)
        transform = before[order]
        change = np.append(True, transform[1:] != transform[:-1])
        self.run_first = np.flatnonzero(change)
        self.run_last = np.append(self.run_first[1:], n) - 1
        self.head, self.tail = order[self.run_first], order[self.run_last]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common start of the suffixes at x and y, inside their texts."""
        n = len(self.data)
        x, y = x.copy(), y.copy()
        out = np.zeros(len(x), np.int64)
        limit = np.minimum(self.stop[x] - x, self.stop[y] - y)
        for step, rank in reversed(self.levels):
            fits = out + step <= limit
            same = fits & (rank[np.minimum(x + out, n - 1)] == rank[np.minimum(y + out, n - 1)])
            out += same * step
        for _ in range(7):
            going = out < limit
            same = going & (self.data[np.minimum(x + out, n - 1)] == self.data[np.minimum(y + out, n - 1)])
            out += same
        return out

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest string that starts there and anywhere else."""
        n = len(self.data)
        at = np.arange(n)
        best = np.zeros(n, np.int64)
        for ranks, positions, side in ((self.run_first, self.head, -1), (self.run_last, self.tail, 1)):
            inner = (ranks + side >= 0) & (ranks + side < n)
            reach = np.zeros(n, np.int64)
            reach[positions[inner]] = positions[inner] + self.common(positions[inner], self.order[ranks[inner] + side])
            best = np.maximum(best, np.maximum.accumulate(reach) - at)
        return best


def _cut(prefix: np.ndarray, anchor: np.ndarray, far: np.ndarray, near: np.ndarray, size: int, length: int) -> tuple[np.ndarray, ...]:
    """(owner, far, near, core) of the blocks of `size` strings, by distance from the anchor, of some contexts.

    Distances fall from `far` to `near` along the strings of a context. core: hash of the bytes that all strings of
    such a block share.
    """
    high, low = far // size, near // size
    number = high - low + 1
    each = np.repeat(np.arange(len(far)), number)
    block = np.repeat(high, number) - (np.arange(len(each)) - np.repeat(np.cumsum(number) - number, number))
    shared = anchor[each] - block * size
    core = signed(span_hash(prefix, shared, shared + length - size + 1))
    return each, np.minimum(far[each], block * size + size - 1), np.maximum(near[each], block * size), core


def _candidates(data: np.ndarray, ends: np.ndarray, far: np.ndarray, h: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(context, first, last): the strings of some contexts that the index has to decide, in stretches.

    Equal strings stand at the same distance from the same anchor. So a block of strings whose core no other block
    of the same anchor and distance has is left out; all contexts of an anchor are among those given.
    """
    near = far - (np.diff(ends) - length)
    each, high, low, core = _cut(prefix_hash(data), ends[:-1] + far, far, near, FINE, length)
    # Blocks of an anchor at one distance get a common key, apart from collisions, which leave out nothing.
    key = mix(h.view(np.uint64)[each] + (high // FINE).astype(np.uint64)) ^ core.view(np.uint64)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    held = np.zeros(len(key), bool)
    held[order[1:]] |= same
    held[order[:-1]] |= same
    each, high, low = each[held], high[held], low[held]
    new = np.append(True, (each[1:] != each[:-1]) | (high[1:] != low[:-1] - 1))[: len(each)]
    heads = np.flatnonzero(new)
    owner = each[heads]
    return owner, far[owner] - high[heads], far[owner] - low[np.append(heads[1:], len(each))[: len(heads)] - 1]


def _marks(data: np.ndarray, ends: np.ndarray, far: np.ndarray, h: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Which strings of the contexts repeat among them: (context, first string, last string) of each run."""
    context, first, last = _candidates(data, ends, far, h, length)
    if not len(context):
        return (np.zeros(0, np.int64),) * 3
    sizes = last - first + length
    stops = np.cumsum(sizes)
    index = RunIndex(data[spread(ends[context] + first, sizes)], stops - sizes, stops)
    hit = np.flatnonzero(index.matching_statistics() >= length)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    new = np.append(True, (np.diff(hit) > 1) | (np.diff(owner[hit]) > 0))[: len(hit)]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(hit))[: len(heads)] - 1
    stretch = owner[hit[heads]]
    base = first[stretch] - (stops - sizes)[stretch]
    return context[stretch], hit[heads] + base, hit[tails] + base


def _indexed(contexts: DataFrame, length: int) -> DataFrame:
    """(row_id, row_hash, first, last): repeated strings by index. Contexts of one anchor are neighbours."""

    def marked(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        data, ends = flat(table["context"])
        at, far, h = (table[c].to_numpy() for c in ("at", "far", "h"))
        context, first, last = _marks(data, ends, far, h, length)
        if len(context):
            keys = [table[c].to_numpy()[context] for c in _KEYS]
            made = [*keys, at[context] + first, at[context] + last]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], [*_KEYS, "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last_h = 0, None
        for batch in batches:
            h, ends = batch.column("h").to_numpy(), flat(batch.column("context"))[1]
            begin = 0
            for b in np.flatnonzero(np.append(last_h is not None, h[1:] != h[:-1])):
                if size + ends[b] - ends[begin] >= INDEX_BYTES and (b or h[0] != last_h):
                    held.append(batch.slice(begin, b - begin))
                    yield from marked(held)
                    held, size, begin = [], 0, b
            if batch.num_rows:
                held.append(batch.slice(begin))
                size, last_h = size + ends[-1] - ends[begin], h[-1]
        if held:
            yield from marked(held)

    return contexts.mapInArrow(run, f"{_ID}, first long, last long")


def _bytes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """data[start : start + size] of each, as a binary column."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data[spread(start, size)])])


_BLOCKS = f"{_ID}, at long, h long, context binary, core long, far long, own boolean"


def _with_context(parts: DataFrame, rows: DataFrame, length: int, blocks: bool) -> DataFrame:
    """Contexts (row_id, row_hash, at, h, context, far) of `parts`; far: the first string's distance from its anchor.

    With `blocks` the strings of a context are cut into blocks (see `_cut`); a row is a block, `at` its first
    string, `far` that string's distance from the anchor, and all blocks are `own`.
    """
    listed = parts.groupBy(*_KEYS).agg(F.collect_list(F.struct("at", "shape", "h")).alias("parts"))
    joined = listed.join(rows, _KEYS)
    names = [*_KEYS, "at", "h", "context", *(["core", "far", "own"] if blocks else ["far"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in slices(flat(whole.column("text"))[1], CONTEXT_BYTES):
                batch = whole.slice(a, b - a)
                data, ends = flat(batch.column("text"))
                lists = batch.column("parts")
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(sizes)), sizes)
                inner = lists.flatten()
                at, shape, h = (inner.field(k).to_numpy() for k in ("at", "shape", "h"))
                shape = shape.astype(np.int64)
                start, more, far = ends[row] + at, shape % 4096, shape // 4096
                cut = [pa.array(far)]
                if blocks:
                    anchor = start + far
                    each, far, near, core = _cut(prefix_hash(data), anchor, far, far - more, BLOCK, length)
                    start, more, row, h = anchor[each] - far, far - near, row[each], h[each]
                    cut = [pa.array(core), pa.array(far), pa.array(np.ones(len(far), bool))]
                keys = [pa.array(batch.column(c).to_numpy()[row]) for c in _KEYS]
                made = [*keys, pa.array(start - ends[row]), pa.array(h), _bytes(data, start, more + length), *cut]
                yield pa.RecordBatch.from_arrays(made, names)

    return joined.mapInArrow(run, _BLOCKS if blocks else f"{_ID}, at long, h long, context binary, far long")


def _finer(blocks: DataFrame, length: int) -> DataFrame:
    """The blocks cut into blocks of FINE strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in range(0, whole.num_rows, 5_000):
                batch = whole.slice(b, 5_000)
                data, ends = flat(batch.column("context"))
                far = batch.column("far").to_numpy()
                anchor = ends[:-1] + far
                each, first, near, core = _cut(prefix_hash(data), anchor, far, far - (np.diff(ends) - length), FINE, length)
                start = anchor[each] - first
                ids, hashes, at, h = (pa.array(batch.column(c).to_numpy()[each]) for c in (*_KEYS, "at", "h"))
                at = pa.array(at.to_numpy() + start - ends[each])
                context = _bytes(data, start, first - near + length)
                own = pa.array(batch.column("own").to_numpy(zero_copy_only=False)[each])
                made = [ids, hashes, at, h, context, pa.array(core), pa.array(first), own]
                yield pa.RecordBatch.from_arrays(made, [*_KEYS, "at", "h", "context", "core", "far", "own"])

    return blocks.mapInArrow(run, _BLOCKS)


def _windows(blocks: DataFrame, length: int) -> DataFrame:
    """(row_id, row_hash, at, h, w, own): the hash of each string of some blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in range(0, whole.num_rows, 5_000):
                batch = whole.slice(b, 5_000)
                data, ends = flat(batch.column("context"))
                number = np.diff(ends) - length + 1
                row = np.repeat(np.arange(len(number)), number)
                start = spread(ends[:-1], number)
                w = signed(span_hash(prefix_hash(data), start, start + length))
                at = batch.column("at").to_numpy()[row] + start - ends[row]
                keys = [pa.array(batch.column(c).to_numpy()[row]) for c in _KEYS]
                own = batch.column("own").to_numpy(zero_copy_only=False)[row]
                made = [*keys, pa.array(at), pa.array(batch.column("h").to_numpy()[row]), pa.array(w), pa.array(own)]
                yield pa.RecordBatch.from_arrays(made, [*_KEYS, "at", "h", "w", "own"])

    return blocks.select(*_KEYS, "at", "h", "context", "own").mapInArrow(run, f"{_ID}, at long, h long, w long, own boolean")


def _settled(blocks: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Repeated strings (row_id, row_hash, first, last) of blocks that repeat as a whole, and the blocks to cut finer.

    A block whose core is unique has no repeat; one that occurs twice as a whole repeats throughout. The others
    go on, and so does one of each repeated block with the core of such a one, as its strings may occur there too:
    it is not `own`, that is, counted but not reported.
    """
    blocks = materialize(blocks.withColumn("whole", F.xxhash64("context")), "blocks")
    cores = blocks.groupBy("h", "core").agg(F.count("*").alias("n")).filter("n > 1").select("h", "core")
    wholes = blocks.groupBy("h", "whole").agg(F.count("*").alias("n")).filter("n > 1").select("h", "whole", F.lit(True).alias("again"))
    alive = blocks.join(cores, ["h", "core"], "left_semi").join(wholes, ["h", "whole"], "left")
    alive = materialize(alive, "alive")
    last = F.col("at") + F.octet_length("context") - length
    settled = alive.filter("own and again").select(*_KEYS, F.col("at").alias("first"), last.alias("last"))
    edges = alive.filter("own and again is null")
    inner = alive.filter("again or not own").join(edges.select("h", "core").distinct(), ["h", "core"], "left_semi")
    one = F.min(F.struct(*_KEYS, "at", "context", "core", "far")).alias("one")
    inner = inner.groupBy("h", "whole").agg(one).select("one.*", "h", F.lit(False).alias("own"))
    return settled, edges.select(inner.columns).unionByName(inner)


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """(row_id, row_hash, first, last): repeated strings of blocks by counting, from coarse to fine.

    Only the strings of small blocks at the edges of what repeats are counted one by one, FINE for each at most.
    """
    coarse, edges = _settled(contexts, length)
    fine, edges = _settled(_finer(edges, length), length)
    # Written: they are counted, and joined to what was counted.
    strings = materialize(_windows(edges, length), "strings")
    often = strings.groupBy("h", "w").agg(F.count("*").alias("n")).filter("n > 1").select("h", "w")
    found = strings.filter("own").join(often, ["h", "w"]).select(*_KEYS, F.col("at").alias("first"), F.col("at").alias("last"))
    return coarse.unionByName(fine).unionByName(found)


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(row_id, row_hash, spans): start and stop of the repeated bytes of each text that has some."""
    rows = _rows(docs)
    found = anchors(rows.filter(F.octet_length("text") >= length), length)
    kind = F.xxhash64("ctx", "shape")
    twice = found.groupBy("h").agg(F.count("*").alias("n"), (F.min(kind) == F.max(kind)).alias("uniform")).filter("n > 1")
    # Written first: a join of two plain exchanges lets Spark split an anchor that very many texts have.
    twice = materialize(twice.select("h", "uniform"), "twice")
    shared = materialize(found.join(twice, "h"), "shared")
    more = F.col("shape") % 4096
    settled = shared.filter("uniform").select(*_KEYS, F.col("at").alias("first"), (F.col("at") + more).alias("last"))

    split = shared.filter("not uniform")
    classes = split.groupBy("h", "ctx", "shape").agg(F.count("*").alias("n"), F.min(F.struct(*_KEYS, "at")).alias("one"))
    classes = materialize(classes, "classes")
    again = split.join(classes.filter("n > 1").select("h", "ctx", "shape"), ["h", "ctx", "shape"])
    again = again.select(*_KEYS, F.col("at").alias("first"), (F.col("at") + more).alias("last"))
    size = classes.groupBy("h").agg(F.count("*").alias("classes"))
    sized = classes.join(size, "h").select("one.*", "shape", "h", "classes")
    few = _with_context(sized.filter(F.col("classes") <= GROUP), rows, length, blocks=False)
    by_index = _indexed(few.repartition("h").sortWithinPartitions("h"), length)

    by_count = _counted(_with_context(sized.filter(F.col("classes") > GROUP), rows, length, blocks=True), length)

    strings = settled.unionByName(again).unionByName(by_index).unionByName(by_count)
    spans = strings.select(*_KEYS, F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    return spans.groupBy(*_KEYS).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def without_repeats(docs: DataFrame, length: int = LENGTH, whole_characters: bool = False) -> DataFrame:
    """`docs` without `text`, with the removed spans, the number of bytes, and the bytes that are left.

    spans: array of maximal removed runs (start, stop), in order; n_bytes; kept: binary. With
    `whole_characters` a UTF-8 character goes if one of its bytes does, so that the rest is text.
    """
    marks = repeats(docs, length)
    key, text = own_column(docs, "_row_id"), own_column(docs, "_text")
    hash_ = own_column(docs, "_row_hash")
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    left = docs.select(
        "*",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias(key),
        F.xxhash64(whole, F.lit(3)).alias(hash_),
        whole.alias(text),
    )
    named = marks.select(F.col("row_id").alias(key), F.col("row_hash").alias(hash_), F.col("spans").alias("_spans_"))
    kept = [c for c in docs.columns if c not in ("spans", "n_bytes", "kept", "text")]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for a, b in slices(flat(whole_batch.column(text))[1], CONTEXT_BYTES):
                batch = whole_batch.slice(a, b - a)
                data, ends = flat(batch.column(text))
                lists = batch.column("_spans_")
                sizes = lists.fill_null([]).value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(sizes)), sizes)
                inner = lists.flatten()
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, ends[row] + inner.field("start").to_numpy(), 1)
                np.add.at(edge, ends[row] + inner.field("stop").to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                if whole_characters and len(gone):
                    character = np.cumsum((data & 0xC0) != 0x80)
                    gone = (np.bincount(character, gone) > 0)[character]
                owner = np.repeat(np.arange(len(sizes)), np.diff(ends))
                before = np.zeros(len(gone), bool)
                before[1:] = gone[:-1] & (owner[1:] == owner[:-1])
                start = np.flatnonzero(gone & ~before)
                after = np.zeros(len(gone), bool)
                after[:-1] = gone[1:] & (owner[1:] == owner[:-1])
                stop = np.flatnonzero(gone & ~after) + 1
                per = np.bincount(owner[start], minlength=len(sizes))
                base = ends[owner[start]]
                spans = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(start - base), pa.array(stop - base)], ["start", "stop"]),
                )
                rest = np.concatenate([[0], np.cumsum(~gone)])[ends].astype(np.int32)
                left_over = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(rest), pa.py_buffer(data[~gone])])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in kept] + [spans, pa.array(np.diff(ends)), left_over], [*kept, "spans", "n_bytes", "kept"]
                )

    joined = left.join(named, [key, hash_], "left").select(*kept, text, "_spans_")
    return joined.mapInArrow(run, f"{fields}, spans array<struct<start:long,stop:long>>, n_bytes long, kept binary")


def digest(cleaned: DataFrame) -> DataFrame:
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return cleaned.select(
        "doc_id",
        "n_bytes",
        size.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


SQL = f"""
with d as (select doc_id, row_number() over () as r, hex(encode(coalesce(text, ''))) as x from documents),
n as (select *, length(x) // 2 as n from d),
w as (select r, i, md5(substr(x, 2 * i + 1, {2 * LENGTH})) as m
  from (select r, x, unnest(range(0, n - {LENGTH - 1})) as i from n where n >= {LENGTH})),
t as (select m from w group by m having count(*) > 1),
h as (select w.r, w.i from w join t using (m)),
g as (select r, i, case when i - lag(i) over (partition by r order by i) <= {LENGTH} then 0 else 1 end as new from h),
s as (select r, i, sum(new) over (partition by r order by i) as k from g),
p as (select r, k, min(i) as a, max(i) + {LENGTH} as b from s group by r, k),
q as (select r, list([a, b] order by a) as l, sum(b - a)::bigint as gone, count(*)::bigint as spans from p group by r),
k as (select n.doc_id, n.n, n.x, coalesce(q.gone, 0) as gone, coalesce(q.spans, 0) as spans, coalesce(q.l, []) as l
  from n left join q using (r)),
z as (select *, list_concat([0], list_transform(l, lambda p: p[2])) as f, list_concat(list_transform(l, lambda p: p[1]), [n]) as u from k)
select doc_id, n::bigint as n_bytes, gone::bigint as n_removed, spans::bigint as n_spans,
  sha256(unhex(array_to_string(list_transform(list_zip(f, u), lambda p: substr(x, 2 * p[1] + 1, 2 * (p[2] - p[1]))), ''))) as kept_sha256
from z
"""
