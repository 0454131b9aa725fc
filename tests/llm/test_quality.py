import os

import numpy as np
import pytest

from postlake.llm import quality

SF_DIR = os.environ.get("TEST_QUALITY_DIR", "/root/testdata/sf0.01")  # enough documents to estimate from


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
def test_against_labels(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    got = quality.classified(docs).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    count = {(r.quality, r.kept): r["count"] for r in got}
    assert count.get((1, True), 0) >= 0.98 * (count.get((1, True), 0) + count.get((1, False), 0))
    assert count.get((0, False), 0) >= 0.7 * (count.get((0, True), 0) + count.get((0, False), 0))


def test_small_cases(spark):
    good = [(i, f"This is sentence {i}, which says a thing or two about the weather in town and the people there.", "c") for i in range(80)]
    junk = [(200 + i, " ".join(f"word{w}### thing{i * w}%%%" for w in range(20)), "c") for i in range(20)]
    more = [(500, None, ""), (501, "", ""), (502, "  \n", ""), (None, good[0][1], ""), (0, good[0][1], ""), (503, "calm words here, as ever. " * 9_000, "")]
    docs = spark.createDataFrame(good + junk + more, "doc_id long, text string, p_bad string")
    got = quality.classified(docs).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == len(good + junk + more)
    assert all(kept[i] for i in [*range(80), 500, 501, 502, None]) and not any(kept[200 + i] for i in range(20))
    rest = quality.filtered(docs)
    assert rest.columns == docs.columns and rest.count() == sum(r.kept for r in got)
    assert quality.classified(docs.limit(0)).collect() == []


def test_estimation_finds_the_labellers():
    draw = np.random.default_rng(1)
    n, labellers = 20_000, len(quality.LABELLERS)
    bad = draw.random(n) < 0.2
    sure = np.linspace(0.95, 0.65, labellers)
    right = draw.random((n, labellers)) < sure
    vote = np.where(right == bad[:, None], quality.BAD, quality.GOOD)
    vote[draw.random((n, labellers)) < 0.3] = quality.ABSTAIN
    pattern, index, count = np.unique(vote @ 3 ** np.arange(labellers), return_inverse=True, return_counts=True)
    found = quality.estimate(pattern, count)[index] > 0.5
    assert (found == bad).mean() > 0.93
