"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of a bounded sample of its labelled texts. A text is parsed
greedily into the longest phrases that occur in the sample; a phrase ends at the byte that does not go on
in the automaton, and the next begins with it. A language that resembles the text needs few phrases. The
count, times the logarithm of the sample's size, per byte is the cross-parsing entropy, and the language
with the least wins; equal ones go to the first by name.

Every labelled language is learned. The automata are built for LANGUAGES_AT_ONCE languages at a time: with more of
them, the texts are written to the shared folder once and read for each group of languages, and the groups' least
entropies of a row are folded in a shuffle of slim rows.

Whole texts are parsed, in pieces of PIECE bytes side by side; a phrase does not go on across pieces,
which costs every language the same. Letters A-Z are lower-cased. The dense table of an automaton has a row per
state and a column per byte value of the samples, so its size is fixed by the sample, not by the corpus.

Null texts and texts without a letter are `und` with score 0, as is everything where no text is labelled.
Repeated rows are scored alike. No rows: none. Other columns are never looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlake.llm.common import LOWER, flat, slices
from postlake.session import materialize

#: Labelled texts of each language that the automata are built of at most, chosen by a hash of the id, and
#: the bytes of them that are used, shared equally among the texts as far as they are long enough.
SAMPLE_TEXTS = 200
SAMPLE_BYTES = 60_000
#: Languages whose automata are in a worker's memory at once.
LANGUAGES_AT_ONCE = 4
PIECE = 1_024
SLICE_BYTES = 6_000_000
UNKNOWN = "und"


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the least automaton whose paths from state 0 are the substrings of `data`."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in data:
        now = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return step


class Parser:
    """Counts the phrases of many texts in all languages at once."""

    def __init__(self, samples: dict[str, bytes]):
        self.names = sorted(samples)
        lowered = {k: LOWER[np.frombuffer(v, np.uint8)].tobytes() for k, v in samples.items()}
        used = sorted({b for v in lowered.values() for b in v})
        self.width = len(used) + 1  # the last column is for bytes that no sample has
        code = np.full(256, self.width - 1, np.int32)
        code[used] = np.arange(len(used))
        self.code = code[LOWER]
        tables, self.roots, base = [], [], 0
        for name in self.names:
            step = suffix_automaton(lowered[name])
            goal = np.full((len(step), self.width), -1, np.int64)
            for state, to in enumerate(step):
                for byte, target in to.items():
                    goal[state, code[byte]] = target
            again = np.maximum(goal[0], 0)
            ended = goal < 0
            goal = np.where(ended, again, goal) + base
            # Row start of the target state, and in the lowest bit whether a phrase ended.
            tables.append((goal * self.width * 2 + ended).astype(np.int32))
            self.roots.append(base * self.width)
            base += len(step)
        self.table = np.concatenate(tables).reshape(-1) if tables else np.zeros(0, np.int32)
        self.weight = np.array([math.log2(max(2, len(lowered[n]))) for n in self.names])

    def phrases(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """texts x languages: number of phrases."""
        sizes = np.diff(ends)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = ends[:-1][owner] + number * PIECE
        size = np.minimum(PIECE, ends[1:][owner] - start)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        active = np.searchsorted(-size, -np.arange(PIECE), "left")
        codes = self.code[data]
        roots = np.array(self.roots, np.int32)[:, None]
        state = np.repeat(roots, len(order), axis=1)
        count = np.zeros((len(roots), len(order)), np.int32)
        for t in range(PIECE):
            k = int(active[t])
            if not k:
                break
            found = self.table[state[:, :k] + codes[start[:k] + t]]
            count[:, :k] += found & 1
            state[:, :k] = found >> 1
        count += state != roots
        out = np.zeros((len(sizes), len(roots)))
        for j in range(len(roots)):
            out[:, j] = np.bincount(owner[order], count[j], len(sizes))
        return out

    def best(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language, its entropy and the sum of all languages' likelihoods relative to it for each text."""
        bits = self.phrases(data, ends) * self.weight
        rate = bits / np.maximum(np.diff(ends), 1)[:, None]
        least = rate.min(axis=1)
        return rate.argmin(axis=1), least, likelihood(rate - least[:, None], np.diff(ends)[:, None]).sum(axis=1)


def likelihood(lead: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Likelihood of a language whose entropy is greater by `lead`, as if at most 64 bytes of the text counted."""
    return np.exp2(-lead * np.clip(sizes, 1, 64))


def shared(texts: list[bytes], total: int) -> bytes:
    """The first bytes of each text, of all equally many as far as they have them, `total` at most."""
    level, left = 0, total
    sizes = sorted(len(t) + 1 for t in texts)
    for k, size in enumerate(sizes):
        level = left // (len(sizes) - k)
        if size > level:
            break
        left, level = left - size, size
    return b"".join((t + b"\n")[: max(level, 1)] for t in texts)[:total]


def samples(labelled: DataFrame) -> DataFrame:
    """(lang, sample): bytes of a bounded sample of each language's texts; null texts and languages are left out."""
    known = labelled.filter("text is not null and lang is not null and text <> ''")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"))
    drawn = (
        known.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= SAMPLE_TEXTS)
        .select("lang", "_n", F.substring("text", 1, SAMPLE_BYTES).alias("text"))
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        texts = [t.encode("utf-8") for t in group.sort_values("_n")["text"]]
        return pd.DataFrame({"lang": [group["lang"].iat[0]], "sample": [shared(texts, SAMPLE_BYTES)]})

    return drawn.groupBy("lang").applyInPandas(run, "lang string, sample binary")


_parsers: dict[int, Parser] = {}


def _parser(held: dict[str, bytes]) -> Parser:
    """Built once per Python worker and set of samples."""
    key = hash(tuple(sorted(held.items())))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(held)
    return _parsers[key]


def predicted(docs: DataFrame, learned: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) of every document; `learned` has a sample of each language."""
    names = sorted(r["lang"] for r in learned.select("lang").collect())
    context = docs.sparkSession.sparkContext
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = plain.withColumn("letter", letter)
    groups = range(0, len(names), LANGUAGES_AT_ONCE)
    if len(groups) > 1:
        # Read once for each group: the numbers of the rows must not change between.
        plain = materialize(plain.withColumn("row", F.monotonically_increasing_id()), "texts")
    else:
        plain = plain.withColumn("row", F.lit(0).cast("long"))

    def scores(first: int) -> DataFrame:
        """(row, doc_id, letter, size, winner, least, mass) by the languages of one group."""
        rows = learned.filter(F.col("lang").isin(names[first : first + LANGUAGES_AT_ONCE])).collect()
        held = context.broadcast({r["lang"]: bytes(r["sample"]) for r in rows})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, ends = flat(batch.column("text"))
                for a, b in slices(ends, SLICE_BYTES):
                    cut = ends[a : b + 1] - ends[a]
                    winner, least, mass = _parser(held.value).best(data[ends[a] : ends[b]], cut)
                    part = batch.slice(a, b - a)
                    columns = [*(part.column(c) for c in ("row", "doc_id", "letter")), *map(pa.array, (np.diff(cut), winner + first, least, mass))]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "letter", "size", "winner", "least", "mass"])

        return plain.mapInArrow(run, "row long, doc_id long, letter boolean, size long, winner long, least double, mass double")

    if not names:
        return plain.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    found = scores(0)
    if len(groups) > 1:
        for first in groups[1:]:
            found = found.unionByName(scores(first))
        # Slim rows, one for each group of languages; equal entropies stay with the first by name.
        each = F.collect_list(F.struct("least", "winner", "mass"))
        found = found.groupBy("row", "doc_id", "letter", "size").agg(each.alias("g"))
        found = found.withColumn("best", F.array_min("g"))
        counted = F.greatest(F.lit(1), F.least(F.lit(64), F.col("size")))
        lead = lambda x: F.pow(F.lit(2.0), (F.col("best.least") - x["least"]) * counted)
        mass = F.aggregate("g", F.lit(0.0), lambda m, x: m + x["mass"] * lead(x))
        found = found.select("doc_id", "letter", F.col("best.winner").alias("winner"), mass.alias("mass"))
    said = F.get(F.array(*map(F.lit, names)), F.col("winner").cast("int"))
    return found.select(
        "doc_id",
        F.when(F.col("letter"), said).otherwise(F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("letter"), 1 / F.col("mass")).otherwise(0.0).alias("score"),
    )


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the rows that are not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    learned = materialize(samples(docs.filter(~held_out).select("doc_id", "text", "lang")), "languages")
    return predicted(docs, learned).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
