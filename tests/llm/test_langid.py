import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import langid

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def parse(text, sample):
    """Greedy phrases of one piece, the plain way."""
    n, at = 0, 0
    while at < len(text):
        end = at
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        if end == at:  # a byte that the sample does not have ends a phrase of its own
            n, at = n + 1, at + 1
        else:
            n, at = n + (end < len(text)), end
            if end == len(text):
                n += 1
    return n


def test_phrases_equal_plain_parse():
    sample = b"the cat sat on the mat. a hat and a bat."
    parser = langid.Parser({"x": sample, "y": b"zzz"})
    for text in (b"the bat sat on a hat", b"cat", b"", b"mat mat mat"):
        got = parser.phrases(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert got[0, 0] == parse(text, sample)


def test_small_cases(spark):
    english = [(i, "the thing that they said was in the other place and this is it " * 3, "en", "c") for i in range(40)]
    german = [(100 + i, "der hund und die katze sind nicht auf dem dach aber unter dem tisch " * 3, "de", "c") for i in range(40)]
    more = [(900, None, "en", ""), (901, "", "de", ""), (902, "123 ... !!", "en", ""), (903, "THE OTHER THING", None, ""), (None, "die katze", None, ""), (904, "der hund " * 20_000, None, "")]
    docs = spark.createDataFrame(english + german + more, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.identified(docs).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None, 904)] == ["und", "und", "und", "en", "de", "de"]
    assert all(got[i].lang_pred == "en" for i in range(40)) and got[900].score == 0.0
    unlabelled = langid.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert langid.identified(docs.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.filter("lang = lang_pred").count(), got.count()
    assert n > 20 and right >= 0.9 * n
    assert got.filter("score < 0 or score > 1").count() == 0


def test_every_language_is_learned(spark):
    # Seventy invented languages of two syllables each; the last has the fewest texts.
    def words(k):
        return f"{chr(97 + k % 26)}{chr(97 + k // 26)}ko {chr(97 + k // 26)}x{chr(97 + k % 26)} " * 8

    rows = [(k * 100 + i, words(k) + str(i), f"l{k:02d}", "") for k in range(70) for i in range(8 if k < 69 else 6)]
    docs = spark.createDataFrame([*rows, (9_999, words(69), None, "")], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.identified(docs).collect()}
    assert len(got) == len(rows) + 1 and all(got[i].lang_pred == lang for i, _, lang, _ in rows)
    assert got[9_999].lang_pred == "l69" and 0 < got[9_999].score <= 1


def test_groups_of_languages_score_as_one(spark, monkeypatch):
    texts = ["the thing and that", "der hund und die katze", "le chat et le chien", "il gatto e il cane", "el perro y el gato", "o gato e o cachorro"]
    docs = spark.createDataFrame([(i, f"{t} {i}", f"l{i % 6}") for i in range(60) for t in [texts[i % 6]]], "doc_id long, text string, lang string")
    apart = sorted(langid.identified(docs).collect())
    monkeypatch.setattr(langid, "LANGUAGES_AT_ONCE", 100)
    whole = sorted(langid.identified(docs).collect())
    assert [r[:3] for r in apart] == [r[:3] for r in whole]
    assert all(abs(a.score - b.score) < 1e-9 for a, b in zip(apart, whole, strict=True))


def test_one_long_text_is_not_the_whole_sample():
    assert langid.shared([b"a" * 100, b"b" * 3, b"c" * 50], 40) == b"a" * 18 + b"bbb\n" + b"c" * 18
    assert langid.shared([b"a" * 5, b"b"], 40) == b"aaaaa\nb\n" and langid.shared([b"a" * 90], 40) == b"a" * 40
