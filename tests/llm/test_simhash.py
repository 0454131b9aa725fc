import random
import re

import numpy as np
import pytest
import xxhash

from postlake.llm import simhash


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def labels(keys, linked):
    """Least key that each key is connected to."""
    label = {k: k for k in keys}
    while True:
        now = {k: min([label[j] for j in keys if linked(k, j)] + [label[k]]) for k in keys}
        if now == label:
            return label
        label = now


def brute(rows):
    made = [(d, fingerprint(t)) for d, t in rows]
    ids = {d for d, _ in made if d is not None}
    of = {d: {f for e, f in made if e == d} for d in ids}
    near = lambda a, b: any(bin(x ^ y).count("1") <= 2 for x in of[a] for y in of[b])
    label = labels(sorted(ids), near)
    return sorted(((d, f"{f:016x}", label.get(d)) for d, f in made), key=str)


def corpus(seed):
    draw = random.Random(seed)
    vocab = [f"W{i}é" for i in range(300)]
    rows = []
    for _ in range(25):
        base = draw.choices(vocab, k=draw.randrange(20, 300))
        for _ in range(draw.randrange(1, 8)):
            copy = list(base)
            for _ in range(draw.randrange(0, 3)):
                copy[draw.randrange(len(copy))] = draw.choice(vocab)
            rows.append((len(rows) * 13 % 997, " ".join(copy)))
    return rows


HARD = [(2000, None), (2001, ""), (2002, " \n"), (2003, "One"), (2004, "oNE"), (2005, "a b"), (2006, "A\tB"), (2007, "a b c"), (None, "a b"), (None, None),
        (2008, "a  b\x0bc D"), (2009, "a b c d"), (2010, "x " * 5000), (2011, "x " * 4999), (2004, "a b"), (2004, "oNE"), (2004, "oNE")]


@pytest.mark.parametrize("bucket", [64, 2])
def test_against_brute_force(spark, bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 97)
    rows = corpus(3) + HARD
    table = spark.createDataFrame([(1, d, t, 5) for d, t in rows], "fp int, doc_id long, text string, key int")
    got = simhash.near_duplicates(table).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


@pytest.mark.parametrize("parts", list(simhash.PARTS.values()))
@pytest.mark.parametrize("bucket", [64, 8, 1])
def test_links_of_fingerprints(spark, parts, bucket, monkeypatch):
    """Clusters around common fingerprints, with any cut and in both ways."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "best_parts", lambda *_: parts)
    draw = random.Random(7)
    fps = {0, 1, (1 << 64) - 1, 1 << 63}
    for _ in range(30):
        base = draw.getrandbits(64)
        for _ in range(draw.choice((1, 3, 25))):
            fps.add(base ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(0, 4))}))
    numbers = sorted(f - (1 << 64 if f >> 63 else 0) for f in fps)
    close = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    found = simhash.links(spark.createDataFrame([(f,) for f in numbers], "fp long")).collect()
    assert all(close(r.a, r.b) for r in found)
    ends = {(r.a, r.b) for r in found} | {(r.b, r.a) for r in found}
    by = {a: {b for x, b in ends if x == a} for a in numbers}
    assert labels(numbers, lambda a, b: b in by[a]) == labels(numbers, close)


def test_thresholds():
    """The allocation spends DISTANCE + 1 units, as cheaply as trying all of them."""
    draw = np.random.default_rng(3)
    cost = np.concatenate([np.zeros((40, 4, 1)), np.cumsum(draw.random((40, 4, 3)), axis=2)], axis=2)
    thresholds, spent = simhash.allocate(cost)
    assert (thresholds + 1).sum(axis=1).tolist() == [3] * 40
    for i in range(40):
        options = [(a, b, c, d) for a in range(4) for b in range(4) for c in range(4) for d in range(4) if a + b + c + d == 3]
        assert np.isclose(spent[i], min(sum(cost[i, p, t] for p, t in enumerate(o)) for o in options))


def test_parts_get_wider():
    flat = np.full((8, 256), 4)
    assert [len(simhash.best_parts(flat, n)) for n in (10, 10**12)] == [3, 2]


def test_correlated_bits_stand_together():
    draw = np.random.default_rng(1)
    bits = draw.integers(0, 2, (4000, 64))
    bits[:, 40] = bits[:, 3]
    bits[:, 17] = 1 - bits[:, 3]
    order = simhash.bit_groups(bits.T @ bits, 4000).tolist()
    assert sorted(order) == list(range(64)) and len({order.index(b) // 8 for b in (3, 17, 40)}) == 1


def test_no_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
