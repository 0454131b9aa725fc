"""Spelling variants: words one edit apart, found by a trie of letter-group counts.

Letters are packed into GROUPS groups of about equal frequency. A word's vector counts its letters by group; words are
arranged in a trie by the successive counts, with the length above them. A word that is one edit away differs from a
word's vector by a surplus of one in one group, a deficit of one in one group, or both, or by nothing if a letter was
replaced within its group. So a word descends with a budget of one surplus and one deficit; a path that spent both
goes on exactly, and the leaf's words are verified letter by letter. A pair is found once: from the shorter word, or
from the word whose partner has the surplus first.

The top of the trie is a table: STRIDE levels at a time, each word goes to the nodes it reaches, until a node holds at
most NODE rows, however common the letters are. What lies below a node is descended in one task, for many nodes at
once. A leaf that is still too large holds words of the same letters; they meet by what is left of them without one
letter, which at most an alphabet of words shares.

Words are the lower-cased (A-Z) runs of Latin letters. By a rule on the CRC-32 of id and run some lose a letter, so that
there are variants to find. Rows without doc_id keep their runs as they are; null texts have none. Repeated rows count
again. No words: no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import LOWER, dictionary, flat, group_of, spread, stretches, texts
from postlake.session import materialize

#: Shortest word in letters, least occurrences, and how much more frequent a form must be.
LETTERS = 7
OCCURRENCES = 2
TIMES = 10
#: Letter groups, of which STRIDE are descended between two looks at the nodes' sizes.
GROUPS = 24
STRIDE = 3
#: Rows of a node up to which one task descends it, and rows that a task takes at once.
NODE = 50_000
PROBES = 8_000
#: Letters compared at once.
COMPARED = 4_000_000

_LATIN = np.zeros(256, bool)
_LATIN[[*range(65, 91), *range(97, 123), 0xC3]] = True
_SYMBOLS = 26 + 64


def words_of(docs: DataFrame) -> DataFrame:
    """(word, n): the words of LETTERS or more that occur OCCURRENCES times or more in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, data, ends in texts(batch.column("text")):
                lead = data == 0xC3
                solid = _LATIN[data]
                solid[1:] |= lead[:-1]
                starts, stops, counts = stretches(solid, ends)
                leads = np.concatenate([[0], np.cumsum(lead)])
                long = stops - starts - (leads[stops] - leads[starts]) >= LETTERS
                owner = group_of(counts)[long]
                codes, found = dictionary(LOWER[data], starts[long], stops[long])
                size = max(1, len(found))
                pairs, times = np.unique(owner * size + codes, return_counts=True)
                head = [None if d is None else zlib.crc32(b"%d:" % d) for d in ids.slice(a, b - a).to_pylist()]
                spelled = found.to_pylist()
                total = np.bincount(pairs % size, weights=times, minlength=len(found)).astype(np.int64)
                more: dict[str, int] = {}
                for pair, n in zip(pairs.tolist(), times.tolist(), strict=True):
                    before, word = head[pair // size], spelled[pair % size]
                    if before is not None and (h := zlib.crc32(word, before)) % 31 == 0:
                        total[pair % size] -= n
                        letters = word.decode()
                        if len(letters) > LETTERS:
                            place = h % len(letters)
                            other = letters[:place] + letters[place + 1 :]
                            more[other] = more.get(other, 0) + n
                kept = np.flatnonzero(total)
                plain = found.take(pa.array(kept)).cast(pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([plain, pa.array(total[kept])], ["word", "n"])
                yield pa.RecordBatch.from_pydict({"word": list(more), "n": list(more.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = plain.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= OCCURRENCES)


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words as numbers below _SYMBOLS, and the offsets of each word."""
    data, ends = flat(column)
    lead = data == 0xC3
    after = np.zeros(len(data), bool)
    after[1:] = lead[:-1]
    number = np.where(after, data.astype(np.int64) - 0x80 + 26, data.astype(np.int64) - 97)
    return number[~lead], ends - np.concatenate([[0], np.cumsum(lead)])[ends]


def letter_groups(vocabulary: DataFrame) -> np.ndarray:
    """The group of each letter: the most frequent letters first, each to the group with the least so far.

    At most _SYMBOLS counts reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SYMBOLS, np.int64)
        for batch in batches:
            total += np.bincount(symbols(batch.column("word"))[0], minlength=_SYMBOLS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_SYMBOLS)), pa.array(total)], ["letter", "n"])

    count = np.zeros(_SYMBOLS, np.int64)
    counted = vocabulary.select("word").mapInArrow(run, "letter long, n long")
    for row in counted.groupBy("letter").agg(F.sum("n").alias("n")).collect():
        count[row["letter"]] = row["n"]
    held = np.zeros(GROUPS, np.int64)
    group = np.zeros(_SYMBOLS, np.int64)
    for letter in np.argsort(-count, kind="stable"):
        group[letter] = np.argmin(held)
        held[group[letter]] += count[letter] + 1
    return group


def vectors(number: np.ndarray, ends: np.ndarray, group: np.ndarray) -> np.ndarray:
    """[word, group]: how many letters of the group the word has."""
    n = len(ends) - 1
    cells = group_of(np.diff(ends)) * GROUPS + group[number]
    return np.bincount(cells, minlength=n * GROUPS).reshape(n, GROUPS)


def _steps(up: int, down: int, levels: range) -> list[tuple[int | None, int | None, int, int]]:
    """(group with a surplus, group with a deficit, budgets left) of the ways through some levels.

    With both budgets the surplus comes first.
    """
    ways: list[tuple[int | None, int | None, int, int]] = [(None, None, up, down)]
    if up:
        ways += [(i, None, 0, down) for i in levels]
    if up and down:
        ways += [(i, j, 0, 0) for i in levels for j in levels if j > i]
    if down and not up:
        ways += [(None, j, up, 0) for j in levels]
    return ways


_ROWS = "node string, word string, n long, up int, down int, own boolean"


def _descend(rows: DataFrame, group: np.ndarray, depth: int) -> DataFrame:
    """Each row at the nodes that it reaches within the next STRIDE levels.

    own: the row stands for the word itself, whose path spends nothing; it is also what others look for.
    """
    levels = range(depth, min(depth + STRIDE, GROUPS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = vectors(*symbols(batch.column("word")), group)[:, depth : levels.stop]
            ups, downs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("up", "down"))
            own = batch.column("own").to_numpy(zero_copy_only=False)
            for budget in ((0, 0), (0, 1), (1, 0), (1, 1)):
                chosen = np.flatnonzero((ups == budget[0]) & (downs == budget[1]))
                if not len(chosen):
                    continue
                part = batch.take(pa.array(chosen))
                for more, less, up, down in _steps(*budget, levels):
                    target = counts[chosen].copy()
                    if more is not None:
                        target[:, more - depth] += 1
                    if less is not None:
                        target[:, less - depth] -= 1
                    real = np.flatnonzero((target >= 0).all(axis=1))
                    if not len(real):
                        continue
                    # Few different counts: each is spelled once.
                    kinds, index = np.unique(target[real], axis=0, return_inverse=True)
                    names = pa.array(["." + ".".join(map(str, k)) for k in kinds.tolist()])
                    at = part.take(pa.array(real))
                    path = pa.compute.binary_join_element_wise(at.column("node"), names.take(pa.array(index.ravel())), "")
                    same = np.full(len(real), more is None and less is None) & own[chosen[real]]
                    yield pa.RecordBatch.from_arrays(
                        [path, at.column("word"), at.column("n"), pa.array(np.full(len(real), up, np.int32)), pa.array(np.full(len(real), down, np.int32)), pa.array(same)],
                        ["node", "word", "n", "up", "down", "own"],
                    )

    return rows.mapInArrow(run, _ROWS)


def _started(vocabulary: DataFrame) -> DataFrame:
    """Each word at its own length with both budgets, and at the next length with a surplus."""
    length = F.char_length("word")
    ways = F.array(
        F.struct(length.alias("l"), F.lit(1).alias("down"), F.lit(True).alias("own")),
        F.struct((length + 1).alias("l"), F.lit(0).alias("down"), F.lit(False).alias("own")),
    )
    rows = vocabulary.select("word", "n", F.explode(ways).alias("w"))
    return rows.select(F.col("w.l").cast("string").alias("node"), "word", "n", F.lit(1).alias("up"), "w.down", "w.own")


def one_edit(number: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b differ in exactly one letter, or b is a with one letter more."""
    la, lb = np.diff(ends)[a], np.diff(ends)[b]
    out = np.zeros(len(a), bool)
    stops = np.cumsum(la)
    low = 0
    while low < len(a):
        high = max(low + 1, int(np.searchsorted(stops, (stops[low - 1] if low else 0) + COMPARED, "right")))
        part = slice(low, high)
        n = la[part]
        t = spread(np.zeros(high - low, np.int64), n)
        x, y = np.repeat(ends[a[part]], n) + t, np.repeat(ends[b[part]], n) + t
        heads = np.cumsum(n) - n
        unlike = number[x] != number[y]
        replaced = np.add.reduceat(unlike, heads, dtype=np.int64) == 1
        longer = np.repeat(lb[part] > n, n)
        unlike_next = number[x] != number[np.where(longer, y + 1, y)]
        first = np.minimum.reduceat(np.where(unlike, t, np.repeat(n, n)), heads)
        last = np.maximum.reduceat(np.where(unlike_next, t, -1), heads)
        out[part] = np.where(lb[part] == n, replaced, (lb[part] == n + 1) & (last < first))
        low = high
    return out


class _Trie:
    """The nodes below some table nodes, level by level, as sorted keys of (parent, count)."""

    def __init__(self, root: np.ndarray, counts: np.ndarray, marks: np.ndarray):
        self.base = int(counts.max(initial=0)) + 3
        self.levels = []
        at = root
        for level in range(counts.shape[1]):
            keys, at = np.unique(at * self.base + counts[:, level], return_inverse=True)
            self.levels.append(keys)
        self.order = np.argsort(marks, kind="stable")
        self.marks = marks[self.order]

    def child(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have a child with this count, and the children."""
        keys = self.levels[level]
        key = node * self.base + count
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        have = (keys[place] == key) & (count >= 0)
        return have, place[have]

    def leaf(self, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds in `order` of the words with these marks."""
        return np.searchsorted(self.marks, mark, "left"), np.searchsorted(self.marks, mark, "right")


def _searched(trie: _Trie, root: np.ndarray, counts: np.ndarray, marks: np.ndarray, weight: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probe, word of the trie) of all leaves that the probes reach within their budgets.

    The mark of a leaf is the sum of its counts times their weights, so a path that has spent its budget goes
    straight to its leaf.
    """
    found = [(np.flatnonzero((up == 0) & (down == 0)), np.zeros(int(((up == 0) & (down == 0)).sum()), np.uint64))]
    both = np.flatnonzero((up == 1) & (down == 1))
    more = np.flatnonzero((up == 1) & (down == 0))
    less = np.flatnonzero((up == 0) & (down == 1))
    spent = np.zeros(len(less), np.uint64)
    node_both, node_more, node_less = root[both], root[more], root[less]
    for level in range(counts.shape[1]):
        w = weight[level]
        have, _ = trie.child(level, node_more, counts[more, level] + 1)
        found.append((more[have], np.full(int(have.sum()), w)))
        have, node_more = trie.child(level, node_more, counts[more, level])
        more = more[have]

        have, _ = trie.child(level, node_less, counts[less, level] - 1)
        found.append((less[have], spent[have] - w))
        have, node_less = trie.child(level, node_less, counts[less, level])
        less, spent = less[have], spent[have]

        have, fresh = trie.child(level, node_both, counts[both, level] + 1)
        less, node_less = np.append(less, both[have]), np.append(node_less, fresh)
        spent = np.append(spent, np.full(len(fresh), w))
        have, node_both = trie.child(level, node_both, counts[both, level])
        both = both[have]
    found.append((both, np.zeros(len(both), np.uint64)))
    probe = np.concatenate([p for p, _ in found])
    low, high = trie.leaf(marks[probe] + np.concatenate([s for _, s in found]))
    return np.repeat(probe, high - low), trie.order[spread(low, high - low)]


def _below(nodes: DataFrame, group: np.ndarray, depth: int) -> DataFrame:
    """(a, na, b, nb) of the words one edit apart that meet at these nodes."""
    n = nodes.count()
    dealt = nodes.withColumn("deal", F.pmod(F.xxhash64("node"), F.lit(max(1, -(-n // NODE)))))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        root, _ = pd.factorize(rows["node"])
        number, ends = symbols(pa.array(rows["word"], pa.large_string()))
        counts = vectors(number, ends, group)[:, depth:]
        weight = np.random.default_rng(1).integers(1, 1 << 63, counts.shape[1], dtype=np.uint64)
        marks = (counts.astype(np.uint64) * weight).sum(axis=1, dtype=np.uint64)
        marks += (root.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        up, down, own = (rows[c].to_numpy() for c in ("up", "down", "own"))
        index = np.flatnonzero(own)
        if not len(index):
            return pd.DataFrame({"a": [], "na": [], "b": [], "nb": []})
        trie = _Trie(root[index], counts[index], marks[index])
        out = []
        for low in range(0, len(rows), PROBES):
            s = slice(low, low + PROBES)
            probe, word = _searched(trie, root[s], counts[s], marks[s], weight, up[s], down[s])
            a, b = probe + low, index[word]
            once = ~own[a] | (a < b) | (marks[a] != marks[b])
            a, b = a[once], b[once]
            near = one_edit(number, ends, a, b)
            out.append((a[near], b[near]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        word, n = rows["word"].to_numpy(), rows["n"].to_numpy()
        return pd.DataFrame({"a": word[a], "na": n[a], "b": word[b], "nb": n[b]})

    return dealt.groupBy("deal").applyInPandas(run, "a string, na long, b string, nb long")


def _by_rest(leaves: DataFrame) -> DataFrame:
    """(a, na, b, nb) at leaves of very many words: they meet by what is left without one letter."""
    length = F.split("node", r"\.")[0].cast("int")
    places = F.sequence(F.lit(1), F.char_length("word"))
    rest = F.transform(places, lambda p: F.struct(p.alias("p"), F.concat(F.substring("word", F.lit(1), p - 1), F.substring("word", p + 1, F.char_length("word"))).alias("r")))
    whole = F.transform(rest, lambda x: F.struct(F.lit(0).alias("p"), x["r"].alias("r")))
    index = leaves.filter("own").select("node", F.col("word").alias("b"), F.col("n").alias("nb"), F.explode(F.array_distinct(F.concat(rest, whole))).alias("k"))
    shorter = F.array(F.struct(F.lit(0).alias("p"), F.col("word").alias("r")))
    probe = leaves.select("node", F.col("word").alias("a"), F.col("n").alias("na"), "own", F.explode(F.when(F.char_length("word") < length, shorter).otherwise(rest)).alias("k"))
    met = probe.join(index, ["node", "k"]).filter(F.when(F.col("own"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    return met.select("a", "na", "b", "nb").distinct()


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(a, na, b, nb): each pair of words that differ by one inserted, deleted or replaced letter, once.

    vocabulary: (word, n) of different words.
    """
    group = letter_groups(vocabulary)
    rows, depth, parts = _started(vocabulary), 0, []
    while True:
        rows = materialize(_descend(rows, group, depth), "nodes")
        depth = min(depth + STRIDE, GROUPS)
        sizes = rows.groupBy("node").agg(F.count("*").alias("rows"), F.count_if("own").alias("words"))
        busy = sizes.filter("words > 0 and rows > 1")
        parts.append(materialize(_below(rows.join(busy.filter(F.col("rows") <= NODE).select("node"), "node"), group, depth), "near"))
        large = materialize(busy.filter(F.col("rows") > NODE).select("node"), "large")
        if large.isEmpty():
            break
        rows = rows.join(large, "node")
        if depth == GROUPS:
            parts.append(materialize(_by_rest(rows), "near"))
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms lead in the end. Each round doubles the steps taken."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(further, "root", "left_semi").isEmpty():
            return now
        now = materialize(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    form is the most frequent near word (ties: the smallest in code-point order) if it occurs TIMES times as often,
    else null; root is where the forms end.
    """
    vocabulary = materialize(words_of(docs), "vocabulary")
    pairs = near_words(vocabulary)
    sides = pairs.select(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("n"), F.col("b").alias("w")).alias("other"))
    sides = sides.unionByName(pairs.select(F.col("b").alias("word"), F.struct((-F.col("na")).alias("n"), F.col("a").alias("w")).alias("other")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("other"))
    found = vocabulary.join(best, "word", "left")
    better = -F.col("other.n") >= TIMES * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(better, F.col("other.w")).alias("form"), F.when(better, -F.col("other.n")).alias("form_n"),
    )
    found = materialize(found, "forms")
    out = found.join(_roots(found.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
with t as (select list_transform(range(256), lambda i: list_reduce(range(8),
  lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
r as (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents),
d as (select doc_id, w, count(*) as n from r where length(w) >= 7 group by doc_id, w),
h as (select w, n, doc_id is not null as known, xor(4294967295, list_reduce(flatten(list_transform(string_split(doc_id || ':' || w, ''),
  lambda x: case when ord(x) < 128 then [ord(x)::bigint] else [195, ord(x)::bigint - 64] end)),
  lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255) + 1]), 4294967295)) as h from d, t),
e as (select case when known and h % 31 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as w, n from h),
v as (select w, sum(n)::bigint as n from e where length(w) >= 7 group by w having sum(n) >= 2),
c as (select w, n, p, substr(w, 1, p - 1) || substr(w, p + 1) as k from (select w, n, unnest(range(1, length(w) + 1)) as p from v)),
s as (select a.w as w, b.w as o, b.n as o_n from c a join c b on a.p = b.p and a.k = b.k and a.w <> b.w
  union select c.w, v.w, v.n from c join v on c.k = v.w
  union select v.w, c.w, c.n from c join v on c.k = v.w),
b as (select w, count(*) as n_near, max(o_n) as o_n, arg_min(o, (-o_n, o)) as o from s group by w),
f as (select v.w, v.n, coalesce(n_near, 0)::bigint as n_near, case when o_n >= 10 * v.n then o end as form,
  case when o_n >= 10 * v.n then o_n end as form_n from v left join b on b.w = v.w),
g as (with recursive g as (select w, w as last, form from f union all select g.w, f.w, f.form from g join f on f.w = g.form)
  select w, last from g where form is null)
select f.w as word, f.form, g.last as root, f.n, f.n_near, f.form_n from f join g on g.w = f.w
"""
