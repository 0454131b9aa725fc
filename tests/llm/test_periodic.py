import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from postlake.llm import periodic


def words_of(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i - q] for i in range(q, len(w))))


def brute_runs(w):
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and smallest_period(w[i : j + q]) == q:
                found.append((i, j - i + q, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    w = words_of(doc_id, text)
    found = brute_runs(w)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    strongest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *strongest, digest(lines), digest(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def corpus(seed):
    draw = random.Random(seed)
    rows = []
    for i in range(150):
        letters = [chr(97 + k) for k in range(draw.choice((1, 2, 3, 30)))]
        w = []
        for _ in range(draw.randrange(0, 9)):
            unit = draw.choices(letters, k=draw.randrange(1, 14))
            w += unit * draw.choice((1, 1, 2, 3, 4, 5, 9)) + unit[: draw.randrange(0, len(unit))]
        rows.append((i * 3, draw.choice((" ", "\n", " \t "))
            .join(w)))
    return rows


HARD = [(500, None), (501, ""), (502, " \n"), (503, "x " * 5), (504, "x " * 6), (505, "É é " * 9), (505, "É é " * 9), (None, "a b " * 8),
        (506, "A a " * 4), (507, "a b c\x0ba b c\x0c" * 3), (508, "word word " * 7)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(periodic, "WORDS_AT_ONCE", 37)
    rows = corpus(seed) + HARD
    table = spark.createDataFrame([(7, d, t, "p") for d, t in rows], "start int, doc_id long, text string, period string")
    got = periodic.periodic_runs(table).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute(d, t) for d, t in rows), key=str)


def test_long_text_and_no_rows(spark):
    draw = random.Random(4)
    unit = [f"u{draw.randrange(900)}" for _ in range(700)]
    text = " ".join(["x"] * 40_000 + unit * 60 + ["y", "z"] * 30_000)
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = periodic.periodic_runs(table).collect()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (3, 0, 40_000, 1, 40_000_000)
    assert row.runs_sha256 == hashlib.sha256(b"0,40000,1\n40000,42000,700\n82000,60000,2\n").hexdigest()
    assert row.collapsed_sha256 == hashlib.sha256(" ".join(["x", *unit, "y", "z"]).encode()).hexdigest()
    assert periodic.periodic_runs(table.limit(0)).collect() == []


def test_square_free_words_have_no_seeds():
    """Thue's ternary word has no squares, so no run; its repeats die out by themselves."""
    w = [0]
    for _ in range(11):
        w = [x for s in w for x in ((0, 1, 2), (0, 2), (1,))[s]]
    start, length, period = periodic.runs(np.array(w), np.array([len(w)]))
    assert len(w) > 1500 and len(start) == len(length) == len(period) == 0
