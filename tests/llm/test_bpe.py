import hashlib
import random

import pytest

from postlake.llm import bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

HARD = [
    None, "", " \n\t", "Hello  World! it's 123", "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|> <|endoftext|", "'LL she'll",
    "a" * 3000, "%" * 500, "ÉCOLE é İ ΑΣ Σ", "é́", "日本語テキスト", "a\x1cb\x00c\x85d​e", "word " * 5000, "abab" * 200,
]


@pytest.fixture(scope="module")
def both():
    path = P.path("word_bpe_49k.json")
    return bpe.load(path), tokenizers.Tokenizer.from_file(path)


def test_rounds_equal_library(both):
    vocabulary, library = both
    draw = random.Random(3)
    made = ["".join(draw.choice("aabcdest'l<|endoftext|> ÉéΣσ%%!19 \n本") for _ in range(draw.randrange(60))) for _ in range(3000)]
    ids, counts = bpe._Encoder(vocabulary).encode(made)
    at = 0
    for text, n, want in zip(made, counts, library.encode_batch(made, add_special_tokens=False), strict=True):
        assert ids[at : at + n].tolist() == want.ids, text
        at += n


def test_query_columns(spark, both):
    vocabulary, library = both
    rows = [(i, t, "keep", [1]) for i, t in enumerate(HARD)] + [(1, "Hello", "x", None), (1, "Hello", "x", None), (None, "a b", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>")
    got = bpe.digest(bpe.encode(docs, vocabulary), vocabulary).collect()
    assert len(got) == len(rows)
    want = []
    for i, t, _, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text)]
        want.append((i, len(ids), *digest))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    empty = bpe.digest(bpe.encode(docs.limit(0), vocabulary), vocabulary)
    assert empty.collect() == []


def test_other_columns_pass(spark, both):
    docs = spark.createDataFrame([(1, "a b", "s", 2.5)], "doc_id long, text string, source string, n double")
    assert bpe.encode(docs, both[0]).columns == ["doc_id", "source", "n", "ids"]
