"""Quality classifier from weak labels: heuristic labellers, expectation-maximisation, a hashed linear scorer.

Each labeller looks at one trait of a whole text and votes good, bad or nothing. The votes of all documents
are counted by pattern; expectation-maximisation over the patterns, of which there are at most 3 to the
number of labellers, estimates how often each labeller says what on good and on bad texts. The posterior
of its pattern is a document's label. A linear scorer is trained on the labels of a bounded sample and
scores every document. No given label is used.

Null and empty texts have no run, every labeller abstains and they are kept: nothing speaks against them.
Repeated rows are scored alike. No rows: none. Other columns are ignored or, in `filtered`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm import linear
from postlake.llm.common import group_of, own_column, texts

#: Documents (about) that the scorer is trained on, chosen by a hash of the id.
SAMPLE = 6_000

#: trait -> (votes good up to, votes bad from); shares of the runs of a text.
LABELLERS = {
    "signs": (0.02, 0.10),
    "capitals": (0.05, 0.20),
    "repeats": (0.05, 0.20),
    "bars": (0.01, 0.10),
    "shouts": (0.01, 0.10),
    "variety": (0.00, 0.85),
    "plain": (0.30, 0.55),
}
ABSTAIN, GOOD, BAD = 0, 1, 2

_SIGNS = np.zeros(256, bool)
_SIGNS[[ord(c) for c in "#$%&*@^~=+<>{}[]\\_"]] = True


def traits(data: np.ndarray, ends: np.ndarray, r: linear.Runs) -> np.ndarray:
    """texts x labellers: the trait of each labeller, NaN where it has nothing to look at."""
    n = len(r.counts)
    owner = group_of(r.counts)
    first = data[r.starts] if len(r.starts) else data[:0]
    letters = r.kind == 1
    total = np.bincount(owner[letters], minlength=n).astype(float)
    total[total < 5] = np.nan

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=n) / total

    words = np.flatnonzero(letters)
    again = np.zeros(len(r.starts), bool)
    if len(words):
        again[words[1:]] = (r.hashes[words[1:]] == r.hashes[words[:-1]]) & (owner[words[1:]] == owner[words[:-1]])
    order = np.lexsort((r.hashes[words], owner[words]))
    h, o = r.hashes[words][order], owner[words][order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    kinds = np.bincount(o[new], minlength=n)
    longer = r.stops - r.starts > 1
    return np.stack(
        [
            share((r.kind == 3) & _SIGNS[first] & longer),
            share(letters & r.capitals),
            share(again),
            share((r.kind == 3) & (first == ord("|"))),
            share((r.kind == 3) & (first == ord("!")) & longer),
            1 - kinds / total,
            share((r.kind == 3)),
        ],
        axis=1,
    )


def votes(trait: np.ndarray) -> np.ndarray:
    low = np.array([x for x, _ in LABELLERS.values()])
    high = np.array([x for _, x in LABELLERS.values()])
    with np.errstate(invalid="ignore"):
        return np.where(trait >= high, BAD, np.where(trait <= low, GOOD, ABSTAIN))


def patterns(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern): the votes on each document as digits to the base 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            for a, b, data, ends in texts(batch.column("text")):
                found = votes(traits(data, ends, linear.runs(data, ends))) @ base
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(found)], ["doc_id", "pattern"])

    return docs.mapInArrow(run, "doc_id long, pattern long")


def estimate(pattern: np.ndarray, count: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of bad for each pattern, by expectation-maximisation.

    The first guess is a bad vote from anyone; a pattern of nothing but abstentions starts as good. Votes
    are smoothed by one each, and the share of bad is kept between 1 and 50 percent.
    """
    digits = pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    bad = np.where((digits == BAD).any(axis=1), 0.9, 0.02)
    for _ in range(rounds):
        share = np.clip((bad @ count) / max(count.sum(), 1), 0.01, 0.5)
        score = np.full(len(pattern), np.log(share) - np.log(1 - share))
        for j in range(digits.shape[1]):
            said = np.stack([np.bincount(digits[:, j], w * count, 3) + 1 for w in (1 - bad, bad)])
            said /= said.sum(axis=1, keepdims=True)
            score += np.log(said[1, digits[:, j]]) - np.log(said[0, digits[:, j]])
        now = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
        if np.abs(now - bad).max(initial=0) < 1e-9:
            break
        bad = now
    return bad


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of the scorer; class 1 is bad."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = patterns(plain).groupBy("pattern").count().orderBy("pattern").toPandas()
    if not len(counted):
        return np.zeros((linear.WIDTH, 2)), np.array([1.0, 0.0])
    posterior = estimate(counted["pattern"].to_numpy(), counted["count"].to_numpy())
    label = dict(zip(counted["pattern"].tolist(), posterior.tolist(), strict=True))
    share = min(1.0, sample / counted["count"].sum())
    chosen = plain.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            for a, b, data, ends in texts(batch.column("text")):
                r = linear.runs(data, ends)
                found = votes(traits(data, ends, r)) @ base
                row, bucket, value = linear.sparse_rows(r)
                offsets = np.searchsorted(row, np.arange(len(found) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array(found),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.astype(np.float32))),
                    ],
                    ["doc_id", "pattern", "bucket", "value"],
                )

    drawn = chosen.select("doc_id", "text").mapInArrow(run, "doc_id long, pattern long, bucket array<int>, value array<float>").toArrow()
    drawn = drawn.sort_by("doc_id")  # the order of sums, and so the model, is the same in every run
    if not drawn.num_rows:
        return np.zeros((linear.WIDTH, 2)), np.array([1.0, 0.0])
    bad = np.array([label[p] for p in drawn.column("pattern").to_pylist()])
    sizes = [len(x) for x in drawn.column("bucket")]
    row = np.repeat(np.arange(len(bad)), sizes)
    bucket = drawn.column("bucket").combine_chunks().flatten().to_numpy().astype(np.int64)
    value = drawn.column("value").combine_chunks().flatten().to_numpy().astype(np.float64)
    return linear.train(row, bucket, value, np.stack([1 - bad, bad], axis=1))


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], out: str = "p_bad") -> DataFrame:
    """`docs` with the probability of bad quality; other columns pass through."""
    held = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    text = own_column(docs, "_text")
    kept = docs.columns
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        for batch in batches:
            parts = []
            for _, _, data, ends in texts(batch.column(text)):
                r = linear.runs(data, ends)
                p = linear.softmax(linear.scores(r, weights, bias))[:, 1]
                parts.append(np.where(r.counts > 0, p, 0.0))
            p = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(p)], [*kept, out])

    return docs.withColumn(text, F.col("text").cast("string")).mapInArrow(run, f"{fields}, `{out}` double")


def classified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, p_bad, kept) of every document."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(plain, fit(plain, sample)).select("doc_id", F.round("p_bad", 6).alias("p_bad"), (F.col("p_bad") < 0.5).alias("kept"))


def filtered(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` whose text is not rejected, with their own columns."""
    p = own_column(docs, "_p_bad")
    return scored(docs, fit(docs, sample), p).filter(F.col(p) < 0.5).drop(p)
