import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from postlake.llm import runindex
from postlake.session import materialize
from tests.llm.test_minhash import brute as groups
from tests.llm.test_runindex import brute as repeats

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(60)
    rows = [tuple(r) for r in given.collect()]
    rows += [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, rows[0][1], "en", "s", 1), (None, rows[1][1], None, "s", 2), rows[2], rows[2]]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "mixing", "bpe"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        rows = out.collect()
        assert name == "bpe" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF_DIR).collect() == []
        if name == "near_duplicates":
            given = [(r.doc_id, r.text) for r in docs.collect()]
            want = {d for d, _, _, kept in groups(given, 5) if kept}
            assert sorted(map(str, (r.doc_id for r in rows))) == sorted(map(str, want))
        if name == "repeats":
            given = [(r.doc_id, r.text) for r in docs.collect()]
            assert len(rows) == len(given)
            gone = {d: n for d, _, n, _, _ in repeats(given, runindex.LENGTH)}
            whole = {d: len((t or "").encode()) for d, t in given}
            assert all(whole[r.doc_id] - len(r.text.encode()) >= gone[r.doc_id] for r in rows)
            assert all(whole[r.doc_id] - len(r.text.encode()) <= gone[r.doc_id] + 6 * 20 for r in rows)
        if name == "bpe":
            assert all(r.n_tokens == len(r.ids) for r in rows) and len(rows) == docs.count()


def test_chain(spark, docs):
    """Every stage on what the one before it kept."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, now, SF_DIR), f"chain-{name}")
        given, rows = [(r.doc_id, r.text) for r in now.collect()], out.collect()
        held = {}
        for d, t in given:
            held.setdefault(d, set()).add(t)
        if name == "quality":
            assert 0 < len(rows) <= len(given) and all(r.text in held[r.doc_id] for r in rows)
        if name == "near_duplicates":
            want = {d for d, _, _, kept in groups(given, 5) if kept}
            assert {r.doc_id for r in rows} == want and all(r.text in held[r.doc_id] for r in rows)
        if name == "repeats":
            gone = {d: n for d, _, n, _, _ in repeats(given, runindex.LENGTH)}
            whole = {d: len((t or "").encode()) for d, t in given}
            assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in given)
            assert all(0 <= whole[r.doc_id] - len(r.text.encode()) - gone[r.doc_id] <= 6 * 20 for r in rows)
        if name == "mixing":
            assert all(r.text in held[r.doc_id] for r in rows)
        if name == "bpe":
            assert len(rows) == len(given)
            for r in rows:
                assert r.ids in [library.encode(t or "", add_special_tokens=False).ids for t in held[r.doc_id]]
        now = out


def test_run_is_registered(spark):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    out = corpus_pipeline.run(spark, SF_DIR)
    assert 0 < out.count() and "ids" in out.columns
