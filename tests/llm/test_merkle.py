import hashlib
import random
import re

from pyspark.sql import functions as F

from postlake.llm import merkle

ROWS = [
    (5, "One. Two.\nThree.\n\nFour."), (9, "é" * 7), (9, "b"), (9, "b"), (2, None), (3, ""), (None, "last. one"), (7, "One. Two.\nThree.\n\nFour."),
    (1, "x " * 40_000),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "clash", 0.5) for i, t in rows], "doc_id long, text string, next string, tree double")


def brute(rows):
    low = -(1 << 63)
    order = sorted(((i if i is not None else low, t or "", i) for i, t in rows), key=lambda r: (-r[0], r[1]))
    out = []
    for k, (_, text, i) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    got = merkle.fingerprints(docs(spark)).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == brute(ROWS)
    roots = {}
    for r in got:
        roots.setdefault(r.doc_id, set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert roots[5] == roots[7] and roots[2] == roots[3] and roots[5] != roots[1]


def test_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 7)
    rows = [(i * i * 37 % 1009, f"text {i % 11}. more") for i in range(300)]
    got = merkle.fingerprints(docs(spark, rows)).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == brute(rows)


def test_small_tables(spark):
    assert merkle.fingerprints(docs(spark).limit(0)).collect() == []
    assert merkle.fingerprints(docs(spark, [(1, "ab")])).first().near_next == 1.0


def leaves_of(text):
    """Sections of paragraphs of sentences."""
    return [[tuple(re.split(r"(?<=[.!?]) ", p)) for p in s.split("\n")] for s in text.split("\n\n")]


def brute_likeness(x, y):
    a, b = ([tuple(s) for s in leaves_of(t)] for t in (x, y))
    shared = sum(len(p) for s in set(a) & set(b) for p in s)
    pa, pb = {p for s in set(a) - set(b) for p in s}, {p for s in set(b) - set(a) for p in s}
    shared += sum(len(p) for p in pa & pb)
    la, lb = {x for p in pa - pb for x in p}, {x for p in pb - pa for x in p}
    return (shared + len(la & lb)) / (shared + len(la | lb))


def brute_edits(x, y):
    a, b = leaves_of(x), leaves_of(y)
    out = []
    for i in range(max(len(a), len(b))):
        if i >= len(a) or i >= len(b):
            out.append((i, -1))
        elif a[i] != b[i]:
            out += [(i, j) for j in range(max(len(a[i]), len(b[i]))) if a[i][j : j + 1] != b[i][j : j + 1]]
    return out


def test_comparison_against_brute_force(spark):
    draw = random.Random(9)

    def text():
        return "\n\n".join("\n".join(" ".join(draw.choices(["A.", "B!", "C", "D?", "|", ""], k=draw.randrange(0, 4))) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(1, 4)))

    pairs = [(text(), text()) for _ in range(150)] + [("a\nb\n\nc\nd", "a\nb\n\nc\nX\ne\n\nnew"), ("", ""), ("same. text", "same. text")]
    trees = spark.createDataFrame(pairs, "x string, y string").withColumns({"l": merkle.tree(F.col("x")), "r": merkle.tree(F.col("y"))})
    got = merkle.likeness(trees, "l", "r", "near").select("x", "y", "near", merkle.edits(F.col("l"), F.col("r")).alias("e"), (F.col("l.root") == F.col("r.root")).alias("same"))
    for r in got.collect():
        assert abs(r.near - brute_likeness(r.x, r.y)) < 1e-12
        assert [tuple(e) for e in r.e] == brute_edits(r.x, r.y)
        assert r.same == (r.x == r.y)
        assert not r.same or (r.near == 1.0 and r.e == [])


def test_edits_of_documents(spark):
    rows = [(2, "One. Two.\nThree. Four."), (1, "Other. Words.\nand. More.")]
    got = {r.doc_id: r for r in merkle.fingerprints(docs(spark, rows)).collect()}
    assert got[2].edits == "0:1,0:2" or got[2].edits == "0:1"
    assert got[2].near_edited > got[2].near_next
