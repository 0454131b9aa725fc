import numpy as np
from pyspark.sql import functions as F

from postlake.llm import mixing

WEIGHTS = {"tea": 1.5, "sea": 0.25}


def corpus(spark):
    tea = [(i, f"tea cup pot kettle leaf green {i} " * (1 + i % 7), "c") for i in range(120)]
    sea = [(1000 + i, f"sea wave boat salt fish blue {i} " * (1 + i % 5), "c") for i in range(120)]
    more = [(3000, None, ""), (3001, "", ""), (None, "tea boat", ""), (5, tea[5][1], ""), (3002, "wave tea " * 30_000, "")]
    docs = spark.createDataFrame(tea + sea + more, "doc_id long, text string, rate string")
    known = [(i, "tea") for i in range(0, 120, 2)] + [(1000 + i, "sea") for i in range(0, 120, 2)] + [(9, None), (None, "tea")]
    return docs, spark.createDataFrame(known, "doc_id long, domain string")


def test_targets_are_met(spark):
    docs, known = corpus(spark)
    got = mixing.rates(docs, known, WEIGHTS).toPandas()
    assert len(got) == docs.count() and (got["rate"] >= 0).all()
    assert got.loc[got["tokens"] == 0, "rate"].eq(1.0).all()
    p = np.stack(got["p"]) / mixing.GRID
    mass = p * got["tokens"].to_numpy()[:, None]
    have, want = mass.sum(axis=0), (mass * got["rate"].to_numpy()[:, None]).sum(axis=0)
    assert np.allclose(want, have * np.array(list(WEIGHTS.values())), rtol=1e-3)


def test_copies(spark):
    docs, known = corpus(spark)
    out = mixing.mixed(docs, known, WEIGHTS)
    assert out.columns == docs.columns
    count = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(count.get(i, 0) in (2, 4) if i == 5 else count.get(i, 0) in (1, 2) for i in range(120))
    assert sum(count.get(1000 + i, 0) for i in range(120)) < 80
    assert count[3000] == count[3001] == count[None] == 1
    rates = spark.range(20_000).select(mixing.copies(F.lit(1.3), F.col("id")).alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
    assert abs(rates[0] - 1.3) < 0.02 and tuple(rates[1:]) == (1, 2)


def test_without_labels_or_rows(spark):
    docs, known = corpus(spark)
    even = mixing.rates(docs, known.limit(0), {"a": 1.0, "b": 1.0}).agg(F.min("rate"), F.max("rate")).first()
    assert tuple(even) == (1.0, 1.0)
    assert mixing.rates(docs.limit(0), known, WEIGHTS).collect() == []


def test_label_domains(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1), (4, None, None), (1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = mixing.label_domains(labels).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "plain"), (2, "low"), (3, "toxic")]


def test_rates_against_a_second_solver(spark):
    """The rates nearest to one copy, by tokens, that meet the targets: closed form, and Newton's method where some clip."""
    draw = np.random.default_rng(4)
    raw = draw.dirichlet([0.6, 0.6, 0.6], 300)
    p = np.rint(raw * mixing.GRID).astype(int)
    tokens = draw.integers(1, 500, len(p)).astype(float)
    share = p / mixing.GRID
    table = spark.createDataFrame([([int(x) for x in row], float(t)) for row, t in zip(p, tokens, strict=True)], "p array<int>, tokens double")
    have = share.T @ tokens
    for weights in ([1.1, 0.9, 1.05], [1.6, 0.3, 1.0]):
        targets = have * np.array(weights)
        steps = mixing.solve(table, targets)
        got = {tuple(r.p): r.w for r in table.select("p", mixing._rate(F.col("p"), steps).alias("w")).collect()}
        rate = np.array([got[tuple(row)] for row in p.tolist()])
        assert (rate >= 0).all() and np.allclose(share.T @ (tokens * rate), targets, rtol=1e-3)
        dual = np.zeros(3)
        for _ in range(200):
            best = np.maximum(0.0, 1.0 - share @ dual)
            alive = best > 0
            slope = (share[alive] * tokens[alive, None]).T @ share[alive]
            dual += np.linalg.solve(slope + 1e-9 * np.eye(3), share.T @ (tokens * best) - targets)
        best = np.maximum(0.0, 1.0 - share @ dual)
        assert np.allclose(share.T @ (tokens * best), targets, rtol=1e-6)
        assert np.allclose(rate, best, atol=1e-4 if best.min() > 0 else 2e-3)
