import math

import numpy as np
from pyspark.sql import functions as F

from postlake.llm import topk


def brute(vectors, queries, k):
    out = []
    for q, v in queries:
        best = sorted((-int(np.dot(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 150)
    monkeypatch.setattr(topk, "QUERY_ROWS", 20)
    draw = np.random.default_rng(1)
    vectors = [(i, draw.integers(-9, 10, 12)) for i in range(700)] + [(1000 + i, np.ones(12, int)) for i in range(60)]
    vectors += [(2000, np.zeros(12, int)), (2001, draw.integers(-9, 9, 5)), (2002, draw.integers(-9, 9, 5))]
    rows = [(i, [int(x) for x in v], "clash") for i, v in vectors] + [(5000, None, ""), (None, [1] * 12, "")]
    base = spark.createDataFrame(rows, "vec_id long, v array<long>, score string")
    picked = [(i, v) for i, v in vectors if i % 20 == 0 or i > 2000]
    got = topk.top_k(base, base.filter("vec_id % 20 = 0 or vec_id > 2000"), k=7).collect()
    assert sorted(map(tuple, got)) == brute(vectors, picked, 7)


def test_components(spark):
    rows = [([0.5, -0.01],), ([float("nan"), 1.0],), ([1.0, None],), ([math.inf],), (None,), ([],)]
    got = spark.createDataFrame(rows, "e array<float>").select(topk.whole_parts(F.col("e")).alias("v")).collect()
    assert [r.v for r in got] == [[32, -1], None, None, None, None, None]


def test_no_rows(spark):
    none = spark.createDataFrame([], "vec_id long, v array<long>")
    assert topk.top_k(none, none).collect() == []


def test_clustered_vectors_leave_cells_out(spark, monkeypatch):
    """Same answers, and queries read a small part of the cells."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 100)
    draw = np.random.default_rng(5)
    centres = draw.integers(-60, 60, (12, 16))
    vectors = [(i, centres[i % 12] + draw.integers(-4, 5, 16)) for i in range(1500)]
    base = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in vectors], "vec_id long, v array<long>")
    queries = base.filter("vec_id % 20 = 0")
    got = topk.top_k(base, queries, k=5).collect()
    picked = [(i, v) for i, v in vectors if i % 20 == 0]
    assert sorted(map(tuple, got)) == brute(vectors, picked, 5)
    placed, cells = topk._dealt(base)
    least = {r.query_id: r.score for r in got if r.rank == 5}
    known = spark.createDataFrame([(i, [int(x) for x in v], float(least[i])) for i, v in picked], "vec_id long, v array<long>, least double")
    rows = {c: n for c, n in cells.rows.items()}
    read = sum(rows[r.cell] for r in topk._first(queries, cells, 5).collect()) + sum(rows[r.cell] for r in topk._rest(known, cells, 5).collect())
    assert read < 0.5 * len(picked) * len(vectors)


def test_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 4)
    rows = [(1, [1, 2]), (1, [2, 1]), (2, [5, 5]), (2, [5, 5]), (3, [0, 1]), (4, [9, 9]), (4, [-9, -9]), (5, [1, 0, 0])]
    base = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = [tuple(r) for r in topk.top_k(base, base.filter("vec_id = 3"), k=4).collect()]
    assert sorted(got) == [(3, 1, 4, 9), (3, 2, 2, 5), (3, 3, 2, 5), (3, 4, 1, 2)]
