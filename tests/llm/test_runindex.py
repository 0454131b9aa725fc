import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from postlake.llm import runindex


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(rows, raw, strict=True):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((d, len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, alphabet="abcdefghij \n"):
    draw = random.Random(seed)
    said = lambda n: "".join(draw.choices(alphabet, k=n))
    passages = [said(draw.randrange(150, 700)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = [said(draw.randrange(0, 300)) for _ in range(4)]
        for k in range(draw.randrange(0, 4)):
            p = draw.choice(passages)
            a = draw.randrange(0, 60)
            parts.insert(k, p[a : len(p) - draw.randrange(0, 60)])
        texts.append("".join(parts))
    for _ in range(20):
        t = list(draw.choice(texts))
        for _ in range(3):
            if t:
                t[draw.randrange(len(t))] = "Z"
        texts.append("".join(t))
    return texts


HARD = [None, "", "a" * 199, "b" * 200, "b" * 201, "c" * 5000, "ab" * 900, "é" * 350, "x" + "é" * 350, "abcdefg " * 400, "q" * 100]


@pytest.mark.parametrize("group", [1_000, 3])
def test_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(runindex, "GROUP", group)
    texts = corpus(1) + corpus(2, "ab") + HARD
    rows = list(enumerate(texts)) + [(3, texts[3]), (4, "other text"), (None, texts[5]), (None, None)]
    table = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, spans string, row_id int")
    got = runindex.digest(runindex.without_repeats(table)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 200)


def test_no_rows_and_whole_characters(spark):
    table = spark.createDataFrame([(1, "a" + "é" * 200), (2, "é" * 200)], "doc_id long, text string")
    assert runindex.without_repeats(table.limit(0)).collect() == []
    for row in runindex.without_repeats(table, length=201, whole_characters=True).collect():
        bytes(row.kept).decode("utf-8")


def test_matching_statistics():
    draw = random.Random(3)
    texts = ["".join(draw.choices("ab", k=draw.randrange(1, 60))).encode() for _ in range(40)]
    sizes = np.array([len(t) for t in texts])
    stops = np.cumsum(sizes)
    index = runindex.RunIndex(np.frombuffer(b"".join(texts), np.uint8), stops - sizes, stops)
    suffixes = [(k, t[i:]) for k, t in enumerate(texts) for i in range(len(t))]
    got = index.matching_statistics()
    for x, (_, s) in enumerate(suffixes):
        best = 0
        for y, (_, u) in enumerate(suffixes):
            if x != y:
                n = 0
                while n < min(len(s), len(u)) and s[n] == u[n]:
                    n += 1
                best = max(best, n)
        assert got[x] == best
    assert len(index.run_first) < len(got)


def test_long_text_in_pieces(monkeypatch):
    """Runs of a text that is worked on in parts cover the same strings as in one."""
    monkeypatch.setattr(runindex, "PIECE", 500)
    text = "".join(random.Random(4).choices("abcdef", k=3000)).encode()
    data, ends = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts = set()
    for _, offset, part, part_ends in runindex._pieces(data, ends, 200):
        _, anchor, first, last, _, _ = runindex._flat_runs(part, part_ends, 200)
        assert ((anchor >= first) & (anchor <= last + 200 - runindex.K)).sum() >= len(first) - 1 or len(first) < 2
        for a, b in zip(first, last, strict=True):
            more = set(range(int(a) + offset, int(b) + offset + 1))
            assert not starts & more
            starts |= more
    assert starts == set(range(3000 - 200 + 1))


def test_few_strings_of_a_hot_anchor_are_made(spark, monkeypatch):
    """Strings are made one by one at the edges of repeats only, and once."""
    monkeypatch.setattr(runindex, "GROUP", 3)
    made = spark.sparkContext.accumulator(0)
    windows = runindex._windows

    def counted(blocks, length):
        out = windows(blocks, length)

        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return out.mapInArrow(run, out.schema)

    monkeypatch.setattr(runindex, "_windows", counted)
    draw = random.Random(5)
    passage = "".join(draw.choices("abcdefgh ", k=420))
    texts = ["".join(draw.choices("xyz", k=50)) + passage[:k] + "#" + passage[k + 1 :] for k in draw.choices(range(420), k=300)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = runindex.digest(runindex.without_repeats(table)).collect()
    assert sorted(map(tuple, got), key=str) == brute(list(enumerate(texts)), 200)
    assert 0 < made.value < 10_000


class InProcess:
    """Stands for a DataFrame whose one mapInArrow runs here."""

    def __init__(self, batches):
        self.batches = batches

    def mapInArrow(self, run, schema):  # noqa: N802
        return list(run(iter(self.batches)))


@pytest.mark.parametrize("index_bytes", [1, 600_000])
def test_index_holds_only_strings_that_may_repeat(monkeypatch, index_bytes):
    """Contexts that share their anchor and nothing near it are not indexed; the others only around what they share."""
    indexed = []

    class Counted(runindex.RunIndex):
        def __init__(self, data, starts, stops):
            indexed.append(len(data))
            super().__init__(data, starts, stops)

    monkeypatch.setattr(runindex, "RunIndex", Counted)
    monkeypatch.setattr(runindex, "INDEX_BYTES", index_bytes)
    draw = random.Random(6)
    said = lambda n: bytes(draw.choices(b"abcdefgh ", k=n))
    anchor, passage = said(runindex.K), said(120)
    alone = [(1, k, said(168) + anchor + said(168)) for k in range(300)]
    shared = [(2, 300 + k, said(168 - 110) + passage[:110] + anchor + passage + said(168 - 120)) for k in range(2)]
    rows = [{"row_id": d, "row_hash": 0, "at": 7, "h": h, "context": c, "far": 168} for h, d, c in alone + shared]
    schema = pa.schema([(k, pa.int64()) for k in ("row_id", "row_hash", "at", "h")] + [("context", pa.binary()), ("far", pa.int64())])
    batches = [pa.RecordBatch.from_pylist(rows[a : a + 100], schema) for a in range(0, len(rows), 100)]
    out = [x for batch in runindex._indexed(InProcess(batches), 200) for x in batch.to_pylist()]
    seen = Counter(c[i : i + 200] for *_, c in alone + shared for i in range(len(c) - 199))
    expected = {(d, 7 + i) for _, d, c in shared for i in range(len(c) - 199) if seen[c[i : i + 200]] > 1}
    assert {(x["row_id"], i) for x in out for i in range(x["first"], x["last"] + 1)} == expected
    assert len(expected) == 2 * (110 + 120 + 32 - 199)
    assert sum(indexed) <= 2 * (110 + 120 + 32 + 2 * runindex.FINE)


def test_runs_of_short_and_empty_texts():
    """Every string of every text lies in one run, with its anchor inside it, whatever lies between the texts."""
    draw = random.Random(7)
    texts = ["".join(draw.choices("abcd", k=k)).encode() for k in (0, 199, 200, 0, 500, 1, 201, 150, 900, 30, 0)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, anchor, first, last, _, _ = runindex._flat_runs(np.frombuffer(b"".join(texts), np.uint8), ends, 200)
    covered = Counter((r, i) for r, a, b in zip(row.tolist(), first.tolist(), last.tolist(), strict=True) for i in range(a, b + 1))
    assert covered == Counter((r, i) for r, t in enumerate(texts) for i in range(len(t) - 199))
    assert ((anchor >= last) & (anchor + runindex.K <= first + 200)).all()
