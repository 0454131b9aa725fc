import random
import re
import zlib

import pyarrow as pa
import pytest

from postlake.llm import spelling


def brute_words(rows):
    count = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                count[word] = count.get(word, 0) + 1
    return {w: n for w, n in count.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = brute_words(rows)
    form, out = {}, []
    around = {w: [v for v in count if near(w, v)] for w in count}
    for w, n in count.items():
        best = min(around[w], key=lambda v: (-count[v], v), default=None)
        form[w] = best if best and count[best] >= 10 * n else None
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(around[w]), count[form[w]] if form[w] else None))
    return sorted(out, key=str)


def corpus(seed):
    draw = random.Random(seed)
    letters = "abcdexéÿÉ"
    words = ["".join(draw.choices(letters, k=draw.randrange(7, 11))) for _ in range(60)]
    for w in list(words):
        for _ in range(draw.randrange(0, 6)):
            i, c = draw.randrange(len(w)), draw.choice(letters)
            words.append(draw.choice((w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + c + w[i:], "".join(sorted(w)))))
    words += ["".join(draw.sample("abbcdef", 7)) for _ in range(40)]
    rows = []
    for i in range(120):
        some = draw.choices(words, weights=[1 + 400 // (k + 1) for k in range(len(words))], k=60)
        rows.append((i, draw.choice((" ", "1", " ", "\n")).join(w.upper() if draw.random() < 0.1 and w.isascii() else w for w in some)))
    return rows


HARD = [(500, None), (501, ""), (502, "1 2 Ā中"), (None, "wordsss wordsss Wordss wordss"), (503, "z" * 3000 + " " + "z" * 3001), (503, "z" * 3000 + " " + "z" * 3001),
        (504, "short short ×÷×÷×÷× ×÷×÷×÷×"),
        # A chain of forms: 2, 20, 200.
        (None, "chainwa " * 2 + "chainwb " * 20 + "chainxb " * 200 + "chainyb " * 200)]


@pytest.mark.parametrize(("node", "groups", "stride", "probes"), [(50_000, 24, 3, 8000), (40, 24, 3, 7), (1, 4, 3, 500), (1, 3, 2, 500)])
def test_against_brute_force(spark, node, groups, stride, probes, monkeypatch):
    for name, value in (("NODE", node), ("GROUPS", groups), ("STRIDE", stride), ("PROBES", probes), ("COMPARED", 50)):
        monkeypatch.setattr(spelling, name, value)
    rows = corpus(groups) + HARD
    table = spark.createDataFrame([("q", d, t, 9) for d, t in rows], "word string, doc_id long, text string, n int")
    want = brute(rows)
    assert sum(r[1] is not None for r in want) > 5 and max(r[4] for r in want) > 3
    assert sorted(map(tuple, spelling.variants(table).collect()), key=str) == want


def test_each_pair_once(spark):
    rows = corpus(5)
    count = brute_words(rows)
    got = spelling.near_words(spark.createDataFrame(list(count.items()), "word string, n long")).collect()
    want = {frozenset((a, b)) for a in count for b in count if a < b and near(a, b)}
    assert len(got) == len(want) and {frozenset((r.a, r.b)) for r in got} == want


def test_one_edit():
    words = ["abc", "abd", "abcd", "xabc", "abxc", "acb", "abc", "ab", "abcde", "é", "è"]
    number, ends = spelling.symbols(pa.array(words))
    pairs = [(i, j) for i in range(len(words)) for j in range(len(words)) if len(words[j]) >= len(words[i])]
    a, b = (pa.array(x).to_numpy() for x in zip(*pairs, strict=True))
    assert spelling.one_edit(number, ends, a, b).tolist() == [near(words[i], words[j]) for i, j in pairs]


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")).collect() == []
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
