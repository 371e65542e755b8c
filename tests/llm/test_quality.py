"""Quality classifier: dual descent, held-out accuracy, edge rows."""

import zlib

import numpy as np

from tidemark.llm import quality as Q
from tidemark.session import table


def test_dual_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 6))
    y = np.sign(x @ rng.normal(size=6) + 0.3 * rng.normal(size=120))
    rows = [(np.arange(6), v) for v in x]
    w, b = Q.dual_descent(rows, y, 6, cost=1.0, epochs=2000, tolerance=1e-9)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()

    best = loss(w, b)
    for _ in range(300):
        assert loss(w + 0.01 * rng.normal(size=6), b + 0.01 * rng.normal()) >= best - 1e-6


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = Q.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels")).join(
        table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 500 and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    good, bad = "the cat sat on a mat and looked around", "buy%%% now!! cheap%%% deal!!"
    docs = spark.createDataFrame(
        [(i, good if i % 2 else bad, 1, 0.5) for i in range(200)]
        + [(500, None, 1, 0.0), (501, "", 1, 0.0), (None, good, 1, 0.0), (1, good, 1, 0.0), (502, bad * 60_000, 1, 0.0)],
        "doc_id long, text string, quality int, score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)] + [(151, None, 0), (None, 1, 0), (900, 1, 0)], "doc_id long, quality int, toxic int")
    rows = Q.score_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is not None and r.doc_id < 200:
            assert (r.score > 0.5) == (r.doc_id % 2 == 1)
    by = {r.doc_id: r.score for r in rows}
    assert by[500] == by[501] and by[502] < 0.5
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.score for r in Q.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.score_documents(docs.limit(0), labels).count() == 0
