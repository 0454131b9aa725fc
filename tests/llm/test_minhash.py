import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import minhash, shingles
from postlake.llm.common import flat
from postlake.llm.unionfind import components


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]


def shingle_set(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width, percent=80):
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d) if d is not None else None
    return sorted(((d, len(sets[i]), least[root(i)], d is None or d == least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=1):
    draw = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = draw.choices(vocab, k=draw.randrange(30, 260))
        for _ in range(draw.randrange(1, 14)):
            copy = list(base)
            for _ in range(draw.randrange(0, max(2, len(base) // 25))):
                copy[draw.randrange(len(copy))] = draw.choice(vocab)
            rows.append((n * 7 % 1000, " ".join(copy)))
            n += 1
    return rows


HARD = [
    (2000, None), (2001, ""), (2002, " \n "), (2003, "One"), (2004, "oNE"), (2005, "a b c"), (2006, "A\tB\nC"), (2007, "a b c d"),
    (2008, "É b c d"), (2009, "é b c d"), (None, "a b c"), (None, None), (2010, "x " * 50_000), (2011, "x " * 49_000), (2012, "a b c"),
]


@pytest.mark.parametrize("width", [4, 5])
def test_against_brute_force(spark, width):
    rows = corpus() + HARD
    table = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, n int, component_id string")
    got = minhash.near_duplicates(table, width=width).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, width)


def test_repeated_rows_and_no_rows(spark):
    table = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    got = minhash.near_duplicates(table).collect()
    assert sorted(map(tuple, got)) == [(3, 2, 3, True), (4, 2, 3, False), (4, 2, 3, False)]
    assert minhash.near_duplicates(table.limit(0)).collect() == []


def test_one_id_with_two_texts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 1)
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(90))
    rows = [(5, a), (5, b), (6, a + " z"), (4, b + " z"), (9, "other text")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {(r.doc_id, r.component_id) for r in got} >= {(6, 4), (4, 4), (9, 9)} and len(got) == 5


def test_one_id_joins_the_classes_of_its_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(90))
    rows = [(5, a), (5, b), (3, b), (6, a + " z"), (8, "one more"), (8, "and another"), (7, "one more"), (2, "and another"), (9, "other text")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    found = sorted((r.doc_id, r.component_id, r.kept) for r in got)
    linked = [(2, 2, True), (3, 3, True), (5, 3, False), (5, 3, False), (6, 3, False), (7, 2, False), (8, 2, False), (8, 2, False)]
    assert found == [*linked, (9, 9, True)]


def test_many_groups_in_one_bucket(spark, monkeypatch):
    """Members that miss the pivots are still compared with the rest of their bucket, or ruled out."""
    draw = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        copy = list(base)
        for j in range(3):
            copy[draw.randrange(120)] = f"x{i}{j}"
        rows.append((i, " ".join(copy)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for small, block in ((16, 1024), (1, 1024), (1, 7)):
        monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = minhash.near_duplicates(table, width=4).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, 4)


def test_overlaps():
    draw = random.Random(8)
    sets = [set(draw.sample(range(60), draw.randrange(1, 30))) for _ in range(150)]
    got = minhash.overlaps(np.array([t for s in sets for t in sorted(s)]), np.array([len(s) for s in sets]))
    assert all(got[i, j] == len(sets[i] & sets[j]) for i in range(150) for j in range(150) if i != j)


def test_signatures_estimate_similarity():
    import pyarrow as pa

    draw = np.random.default_rng(2)
    common, a, b = (draw.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) for n in (800, 100, 100))
    sets = np.concatenate([np.sort(np.append(common, a)), np.sort(np.append(common, b)), common[:1]])
    signature = minhash.super_minhash(sets, np.array([900, 900, 1, 0]), 160)
    assert abs((signature[0] == signature[1]).mean() - 0.8) < 0.12
    assert len(set((signature[2] >> np.uint64(32)).tolist())) == 160  # one element has every rank once
    assert (signature[3] == np.iinfo(np.uint64).max).all()
    data, ends = flat(pa.array(["a b a b a b", None]))
    made, counts = shingles.shingle_sets(data, ends, 2)
    assert counts.tolist() == [2, 0] and len(made) == 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 199)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def thue_morse(letters, length):
    return "".join(letters[bin(i).count("1") % 2] for i in range(length))


def test_words_that_a_polynomial_would_confuse(spark):
    rows = [(1, thue_morse("ab", 2048)), (2, thue_morse("ba", 2048)), (3, thue_morse("AB", 2048))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 1)]


def test_a_large_group_is_not_compared_with_itself(spark, monkeypatch):
    """One group of a bucket in many blocks, and some outsiders: as many tasks as the group has blocks."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 4)
    monkeypatch.setattr(minhash, "BLOCK", 50)
    rest = spark.range(1000).selectExpr("7L as key", "1003L as size", "id", "50L as n", "0L as g")
    rest = rest.unionByName(spark.range(1000, 1003).selectExpr("7L as key", "1003L as size", "id", "50L as n", "id as g"))
    shape = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.when(i < 48, i).otherwise(i + 100 * F.col("id")).cast("long"))
    sets = rest.select("id", F.when(F.col("id") < 1002, shape).otherwise(F.transform(shape, lambda x: x + 10_000)).alias("s"))
    found = minhash._many(rest, sets, 80).collect()
    linked = {x for r in found for x in (r.a, r.b)}
    assert {1000, 1001} <= linked and 1002 not in linked
    dealt = minhash._blocks(rest.select("key", "id", "g"))
    assert dealt.select("block").distinct().count() <= 21
