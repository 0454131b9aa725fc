"""Mixing documents to target weights by soft membership.

A classifier learned from a table of labelled documents gives every document a posterior over the domains.
Nonnegative rates are then sought, as near as possible to one copy of everything, with which the expected
tokens of each domain (rate times tokens times posterior, summed over documents) match their targets: least
squares by projected gradient. A step moves a document's rate against the gradient scaled by its tokens, so
two documents with one posterior always have one rate. Posteriors are therefore rounded to 1 / GRID and the
steps run over the table of distinct posteriors, whose size the grid bounds, with one aggregation each.

A rate becomes copies: its whole part, and one more with the rest as probability, decided by a hash of the
id, so reruns agree. Rows with null or empty text have no tokens and keep a rate of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm import linear
from postlake.llm.common import own_column, texts
from postlake.session import materialize

GRID = 200
#: Labelled documents (about) that the classifier is trained on, chosen by a hash of the id.
SAMPLE = 6_000
ROUNDS = 60


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxicity labels; one of several labels of a document counts."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "plain")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("domain")).dropna()
    return known.groupBy("doc_id").agg(F.max("domain").alias("domain"))


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a softmax regression on hashed features; domain i is class i.

    labelled: (doc_id, domain). Without any labelled document all domains are equally likely.
    """
    n = labelled.count()
    share = min(1.0, sample / n) if n else 0.0
    limit = int(share * 1_000_000) + 1
    chosen = labelled.filter(F.col("domain").isin(domains) & (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < limit))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = found.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, ends in texts(batch.column("text")):
                row, bucket, value = linear.sparse_rows(linear.runs(data, ends))
                offsets = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        batch.column("domain").slice(a, b - a),
                        pa.ListArray.from_arrays(offsets, pa.array(bucket.astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(value.astype(np.float32))),
                    ],
                    ["doc_id", "domain", "bucket", "value"],
                )

    joined = found.join(chosen, "doc_id").select("doc_id", "domain", "text")
    drawn = joined.mapInArrow(run, "doc_id long, domain string, bucket array<int>, value array<float>").toArrow().sort_by("doc_id")
    if not drawn.num_rows:
        return np.zeros((linear.WIDTH, len(domains))), np.zeros(len(domains))
    sizes = [len(x) for x in drawn.column("bucket")]
    row = np.repeat(np.arange(len(sizes)), sizes)
    bucket = drawn.column("bucket").combine_chunks().flatten().to_numpy().astype(np.int64)
    value = drawn.column("value").combine_chunks().flatten().to_numpy().astype(np.float64)
    number = {d: i for i, d in enumerate(domains)}
    target = np.eye(len(domains))[[number[d] for d in drawn.column("domain").to_pylist()]]
    return linear.train(row, bucket, value, target)


def posteriors(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, tokens, p): runs without white space, and posterior of each domain in units of 1 / GRID."""
    held = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value
        for batch in batches:
            for a, b, data, ends in texts(batch.column("text")):
                r = linear.runs(data, ends)
                p = np.rint(linear.softmax(linear.scores(r, weights, bias)) * GRID).astype(np.int32)
                offsets = pa.array(np.arange(b - a + 1, dtype=np.int32) * p.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(r.counts), pa.ListArray.from_arrays(offsets, pa.array(p.reshape(-1)))],
                    ["doc_id", "tokens", "p"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, tokens long, p array<int>")


def _rate(p: Column, steps: list[np.ndarray]) -> Column:
    """Rate after the given steps; each is what one unit of each domain's posterior takes off, and clips at 0."""
    rate = F.lit(1.0)
    if steps:
        taken = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])

        def step_down(w: Column, step: Column) -> Column:
            change = F.aggregate(F.zip_with(p, step, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
            return F.greatest(F.lit(0.0), w - change / GRID)

        rate = F.aggregate(taken, F.lit(1.0), step_down)
    return rate


def solve(table: DataFrame, targets: np.ndarray, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Steps of projected gradient for distinct posteriors (p, tokens) and expected tokens per domain.

    The step is the inverse of the Gram matrix of the posteriors weighted by tokens, the exact one for rates
    that are not clipped, damped to stay stable where some are. Only sums per domain reach the driver.
    """
    d = len(targets)
    share = [F.get("p", F.lit(j)) / GRID for j in range(d)]
    gram = np.array(
        table.agg(*[F.coalesce(F.sum(F.col("tokens") * share[i] * share[j]), F.lit(0.0)) for i in range(d) for j in range(d)]).first(), float
    ).reshape(d, d)
    if not gram.any():
        return []
    size = np.trace(gram) / d
    scale = np.linalg.inv(gram + 1e-6 * size * np.eye(d))
    steps: list[np.ndarray] = []
    damp = 1.0
    past = np.inf
    for _ in range(rounds):
        rate = _rate(F.col("p"), steps)
        now = np.array(table.select("p", "tokens", rate.alias("w")).agg(*[F.sum(F.col("tokens") * F.col("w") * s) for s in share]).first(), float)
        off = now - targets
        miss = np.abs(off).max() / max(np.abs(targets).max(), 1.0)
        if miss < 1e-6:
            break
        if miss > past:
            damp *= 0.5
        past = miss
        steps.append(damp * scale @ off)
    return steps


def rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], sample: int = SAMPLE) -> DataFrame:
    """(doc_id, tokens, p, rate) of every document.

    weights: what each domain's expected tokens are to be multiplied with. Posteriors come in the order of
    `weights`.
    """
    domains = list(weights)
    model = learn(docs, labelled, domains, sample)
    found = materialize(posteriors(docs, model), "posteriors")
    table = materialize(found.filter("tokens > 0").groupBy("p").agg(F.sum("tokens").cast("double").alias("tokens")), "grid")
    share = [F.get("p", F.lit(j)) / GRID for j in range(len(domains))]
    have = table.agg(*[F.coalesce(F.sum(F.col("tokens") * s), F.lit(0.0)) for s in share]).first()
    targets = np.array(have, float) * np.array([weights[d] for d in domains])
    steps = solve(table, targets)
    rate = F.when(F.col("tokens") > 0, _rate(F.col("p"), steps)).otherwise(F.lit(1.0))
    return found.select("doc_id", "tokens", "p", rate.alias("rate"))


def copies(rate: Column, *identity: Column) -> Column:
    """Whole copies of a row whose expected number is `rate`."""
    draw = F.pmod(F.xxhash64(*identity, F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], sample: int = SAMPLE) -> DataFrame:
    """`docs` with each row as often as its rate says; rows without doc_id stay as they are."""
    number = own_column(docs, "_copies")
    found = rates(docs, labelled, weights, sample).select("doc_id", copies(F.col("rate"), F.col("doc_id")).alias(number))
    found = found.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(number).alias(number))
    joined = docs.join(found, "doc_id", "left").withColumn(number, F.coalesce(number, F.lit(1)))
    return joined.filter(F.col(number) > 0).withColumn(number, F.explode(F.sequence(F.lit(1), F.col(number)))).select(*docs.columns)
