"""Periodic runs of words: seeds on diagonals, extended once per lag.

A run of smallest period q and length of at least max(LEAST, TIMES * q) compares words i and i + q over a stretch of at
least max(LEAST - q, (TIMES - 1) * q) words. For periods from 2**j to 2**(j+1) - 1 this guarantees an overlap of
k = 3 * 2**j words (five for period 1), so an index of all k-grams of a document holds every run as pairs of
occurrences. k is at least q, so inside a run a k-gram comes back after q words and not before: only an occurrence
and its next one have to be paired, which are as many pairs as words, and a pair whose stretch has a smaller period
never appears. Names of k-grams come from pairs of names of half the length, exactly; a k-gram that occurs once in its
document leaves the index with all longer ones.

Seeds are walked by lag and position. The first one of a stretch is extended and moves its lag's covered mark; seeds
below the mark are suppressed. Every stretch therefore costs one extension, however many seeds it has.

Documents are independent: no shuffle. Rows without doc_id are never rewritten by `rewritten`; null texts have no words.
Repeated rows each give a row. No rows: none. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import dictionary, spread, texts, words

#: Shortest run in words, and in periods.
LEAST = 6
TIMES = 4
#: Words hashed at once, which bounds the working memory of a long text.
WORDS_AT_ONCE = 200_000

SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """A number from 0 for each key that occurs more than once, -1 for the others."""
    _, index, count = np.unique(keys, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    return np.where(count > 1, number, -1)[index]


def _seeds(name: np.ndarray, stop: np.ndarray, width: int, shift: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and lags from low to high - 1 of (width + shift)-grams and their next occurrence."""
    at = np.flatnonzero(name[: max(0, len(name) - shift)] >= 0)
    at = at[(name[at + shift] >= 0) & (at + shift + width <= stop[at])]
    key = name[at] * (name.max(initial=0) + 1) + name[at + shift]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    i, lag = at[order][:-1][same], np.diff(at[order])[same]
    near = (lag >= low) & (lag < high)
    return i[near], lag[near]


def _extended(i: np.ndarray, lag: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the stretches that the seeds cover.

    A seed one word after another of its lag lies below that one's covered mark.
    """
    order = np.lexsort((i, lag))
    i, lag = i[order], lag[order]
    fresh = np.ones(len(i), bool)
    fresh[1:] = (lag[1:] != lag[:-1]) | (i[1:] != i[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first, len(i))[1:] - 1
    start, period = i[first], lag[first]
    length = i[last] + gram - start + period
    long = length >= np.maximum(LEAST, TIMES * period)
    return start[long], length[long], period[long]


def runs(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the texts that `counts` cuts the word codes into.

    Starts are positions in `codes`, in ascending order of (start, period).
    """
    ends = np.cumsum(counts)
    stop = np.repeat(ends, counts)
    name = _repeated(np.repeat(np.arange(len(counts)), counts) * (codes.max(initial=0) + 1) + codes)
    found = []
    width = 1
    while (name >= 0).any():
        if width == 4:
            i, lag = _seeds(name, stop, 4, 1, 1, 2)
            found.append(_extended(i, lag, 5))
        if width >= 4:
            i, lag = _seeds(name, stop, width, width // 2, width // 2, width)
            found.append(_extended(i, lag, width + width // 2))
        at = np.flatnonzero(name[: max(0, len(name) - width)] >= 0)
        at = at[(name[at + width] >= 0) & (at + 2 * width <= stop[at])]
        wide = np.full(len(name), -1)
        wide[at] = _repeated(name[at] * (name.max(initial=0) + 1) + name[at + width])
        name = wide
        width *= 2
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    start, length, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def rewritten(ids: list[int | None], counts: np.ndarray) -> np.ndarray:
    """For each word of the texts, the word that stands there: some texts become periodic from some word on.

    With h the CRC-32 of the decimal id and g = h // 10, a text of n words with h % 10 = 0 repeats, from word a = g % n
    on, its p = 1 + (n - a) // (3 + g % 8) words from there.
    """
    take = np.arange(int(counts.sum()))
    first = np.cumsum(counts) - counts
    for d, f, n in zip(ids, first.tolist(), counts.tolist(), strict=True):
        h = 1 if d is None else zlib.crc32(b"%d" % d)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            take[f + a : f + n] = f + a + np.arange(n - a) % p
    return take


def _joined_digests(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, counts: np.ndarray) -> list[str]:
    """SHA-256 of each text's words joined by a space."""
    made = [hashlib.sha256() for _ in counts]
    ends = np.cumsum(counts)
    for low in range(0, len(starts), WORDS_AT_ONCE):
        high = min(low + WORDS_AT_ONCE, len(starts))
        sizes = stops[low:high] - starts[low:high] + 1
        places = np.concatenate([[0], np.cumsum(sizes)])
        joined = data[spread(starts[low:high] - 1, sizes)]
        joined[places[:-1]] = 0x20
        a, b = np.searchsorted(ends, [low, high - 1], "right")
        for t in range(a, b + 1):
            f = max(ends[t] - counts[t], low)
            if f < min(ends[t], high):
                skip = int(f == ends[t] - counts[t])
                made[t].update(joined[places[f - low] + skip : places[min(ends[t], high) - low]].tobytes())
    return [m.hexdigest() for m in made]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: how many runs its words have, the strongest one, and digests of all of them.

    The strongest run has the greatest length / period, then the smallest start and period; without a run its four
    columns are null. runs_sha256 digests the lines `start,length,period` in order of start and period;
    collapsed_sha256 the words that no run holds after its first period, joined by a space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, data, ends in texts(batch.column("text")):
                starts, stops, counts = words(data, ends)
                first = np.cumsum(counts) - counts
                own = ids.slice(a, b - a)
                take = rewritten(own.to_pylist(), counts)
                codes = dictionary(data, starts, stops)[0][take]
                start, length, period = runs(codes, counts)
                owner = np.searchsorted(first + counts, start, "right")
                n_runs = np.bincount(owner, minlength=b - a)
                at = start - first[owner]

                best = np.lexsort((period, start, -(length / period), owner))
                heads = best[np.searchsorted(owner[best], np.flatnonzero(n_runs))]
                strongest = []
                for values in (at, length, period, 1000 * length // period):
                    column = np.zeros(b - a, np.int64)
                    column[owner[heads]] = values[heads]
                    strongest.append(pa.array(column, mask=n_runs == 0))

                texts_of = [""] * (b - a)
                bounds = np.concatenate([[0], np.cumsum(n_runs)])
                for t in np.flatnonzero(n_runs).tolist():
                    s = slice(bounds[t], bounds[t + 1])
                    lines = zip(at[s].tolist(), length[s].tolist(), period[s].tolist(), strict=True)
                    texts_of[t] = "".join(f"{x},{y},{z}\n" for x, y, z in lines)

                edge = np.zeros(len(codes) + 1, np.int64)
                np.add.at(edge, start + period, 1)
                np.add.at(edge, start + length, -1)
                kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                per_text = np.diff(np.searchsorted(kept, np.append(first, len(codes))))
                collapsed = _joined_digests(data, starts[take[kept]], stops[take[kept]], per_text)
                digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts_of]
                yield pa.RecordBatch.from_arrays(
                    [own, pa.array(n_runs.astype(np.int64)), *strongest, pa.array(digests), pa.array(collapsed)],
                    ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, SCHEMA)


SQL = r"""
with t as (select list_transform(range(256), lambda i: list_reduce(range(8),
  lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
d as (select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
  lambda x: x <> '') as w from documents),
c as (select r, doc_id, w, len(w) as n, xor(4294967295, list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint),
  lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255) + 1]), 4294967295)) as h from d, t),
p as (select r, doc_id, w, n, h, (h // 10) % n as a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) as p from c),
e as (select r, doc_id, n, case when h % 10 = 0 and n > 0
  then list_transform(range(n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % p + 1] end) else w end as w from p),
x as (select r, n, unnest(range(n - 4)) as i, unnest(list_transform(range(n - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) as g from e),
s as (select a.r, a.i, b.i - a.i as q from x a join x b on a.r = b.r and a.g = b.g and a.i < b.i and 4 * (b.i - a.i) <= a.n),
k as (select r, q, i, i - row_number() over (partition by r, q order by i) as k from s),
m as (select r, q, min(i) as s, max(i) - min(i) + 5 + q as l from k group by r, q, k having max(i) - min(i) + 5 + q >= greatest(6, 4 * q)),
f as (select m.r, m.q, m.s, m.l from m where not exists (select 1 from m o where o.r = m.r and o.q < m.q and o.s <= m.s and o.s + o.l >= m.s + m.l)),
b as (select r, s, l, q from f qualify row_number() over (partition by r order by l / q desc, s, q) = 1),
u as (select r, count(*) as n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) as lines from f group by r),
z as (select distinct r, unnest(range(s + q, s + l)) as i from f),
v as (select r, unnest(range(n)) as i, unnest(w) as w from e),
o as (select v.r, string_agg(v.w, ' ' order by v.i) as kept from v anti join z on v.r = z.r and v.i = z.i group by v.r)
select e.doc_id, coalesce(u.n_runs, 0)::bigint as n_runs, b.s::bigint as start, b.l::bigint as length, b.q::bigint as period,
  (1000 * b.l // b.q)::bigint as exponent_milli, sha256(coalesce(u.lines, '')) as runs_sha256, sha256(coalesce(o.kept, '')) as collapsed_sha256
from e left join b on b.r = e.r left join u on u.r = e.r left join o on o.r = e.r
"""
