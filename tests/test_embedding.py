"""Vectors go on batch by batch."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import embedding, text
from tidemark.operators import retrieval


def test_embed_yields_each_batch_before_the_next():
    model = embedding.HashEmbedder(8)
    sizes = []

    class Seen(embedding.HashEmbedder):
        def embed_batch(self, texts):
            sizes.append(len(texts))
            return super().embed_batch(texts)

    texts = pd.Series([None if i == 4 else f"text {i}" for i in range(10)])
    out, made = [], []
    for vectors in embedding.batch_vectors(iter([texts, texts[:0], texts[:2]]), Seen(8), 3):
        out.append(vectors)
        made.append(len(sizes))
    assert made == [1, 2, 3, 4, 5] and [len(v) for v in out] == sizes == [3, 3, 3, 1, 2]
    want = model.embed_batch(["" if t is None else t for t in texts])
    assert np.array_equal(np.stack([v for s in out[:4] for v in s]), want)


def test_embed_of_many_rows_equals_the_embedder(spark):
    docs = spark.range(1000).select("id", F.when(F.col("id") % 9 != 0, F.concat(F.lit("é"), F.repeat("id", 5))).alias("content")).coalesce(2)
    model = embedding.HashEmbedder(16)
    rows = embedding.embed(docs, model, batch_size=7).collect()
    assert len(rows) == 1000
    for r in rows:
        assert np.array_equal(np.float32(r.embedding), model.embed_batch([r.content or ""])[0])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_computes_stored_vectors_once(spark):
    """And a null vector is no hit, while one of another length scores 0."""
    docs = spark.createDataFrame([(1, "abc"), (2, "abcdef"), (3, None)], "doc_id long, text string")
    model = embedding.HashEmbedder(4)
    index = retrieval.build_index(docs, model, 4, 0)
    asked = embedding.embed(spark.createDataFrame([(0, "abc")], "query_id long, text string"), model, "text")
    found = retrieval.vector_search(asked, index, 3)
    assert _plan(found).count("ArrowEvalPython") == 1
    assert {r.id for r in found.collect()} == {"1_chunk_0", "2_chunk_0", "2_chunk_1"}
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0])], "id long, embedding array<float>")
    hits = retrieval.vector_search(spark.createDataFrame([(0, [2.0, 0.0])], "query_id long, embedding array<float>"), store, 3)
    assert [(r.id, r.score) for r in hits.orderBy("rank").collect()] == [(1, 1.0), (3, 0.0)]


def test_chunks_do_not_carry_the_whole_text(spark):
    docs = spark.createDataFrame([(1, "aé𝄞" * 7), (2, ""), (3, None), (4, "x" * 10)], "doc_id long, text string")
    chunks = text.chunk_text(docs, 10, 2)
    vectors = embedding.embed(chunks, embedding.HashEmbedder(4))
    above = _plan(vectors).split("Generate")[0]
    assert "text#" not in above
    whole = {1: "aé𝄞" * 7, 2: "", 4: "x" * 10}
    got = {(r.doc_id, r.chunk_index): (r.content, r.start_index, r.end_index) for r in chunks.collect()}
    want = {(d, i): (t[at : at + 10], at, min(at + 10, len(t))) for d, t in whole.items() for i, at in enumerate(range(0, max(1, len(t) - 2), 8))}
    assert got == want
