"""Vector, chunk and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import embedding, text
from tidemark.operators import retrieval as op
from tidemark.session import spread, table


def _store(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("ns_"), "label").alias("namespace"), "label"
    )


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def _queries(spark, sf_dir):
    """One query per label: the vector of its smallest id."""
    return (
        table(spark, sf_dir, "embeddings")
        .groupBy("label")
        .agg(F.min_by("embedding", "vec_id").alias("embedding"))
        .select(F.col("label").alias("query_id"), "embedding")
    )


_Q = "q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS qv FROM embeddings GROUP BY 1)"
_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[]))"
_L2 = "list_sum(list_transform(list_zip(embedding, qv), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"


def _rank_sql(score, order, source="q, embeddings", where="true", k=10):
    return f"""s AS (SELECT query_id, vec_id AS id, {score} AS score, label FROM {source} WHERE {where}),
        r AS (SELECT * REPLACE (round(score, 6) AS score), CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}, id) AS INTEGER) AS rank FROM s)"""


def _rounded(df, column="score"):
    """Compared at six decimals with the SQL; ranked by the operator on scores as they are."""
    return df.withColumn(column, F.round(column, 6))


def vector_topk(spark, sf_dir):
    return _rounded(op.vector_search(_queries(spark, sf_dir), _store(spark, sf_dir), k=10, threshold=0.05))


def vector_topk_filtered(spark, sf_dir):
    return _rounded(op.vector_search(_queries(spark, sf_dir), _store(spark, sf_dir), k=5, where={"label": {"$in": [3]}}, namespace="ns_3"))


def cosine(spark, sf_dir):
    pairs = _store(spark, sf_dir).join(_queries(spark, sf_dir).withColumnRenamed("embedding", "qv"), F.col("query_id") == F.col("label"))
    return pairs.select("id", F.round(op.cosine(F.col("embedding"), F.col("qv")), 6).alias("score"))


def distances(spark, sf_dir):
    return _rounded(op.vector_query(_store(spark, sf_dir), _queries(spark, sf_dir), include=["label"], k=8), "distance")


def query_by_id(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.max("vec_id").alias("id"))
    return _rounded(op.search_by_id(_store(spark, sf_dir), ids.select("id"), k=4))


def _words(df, key, column):
    """Lower-cased words with their counts: one sparse vector per row."""
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(column), F.lit(r"([\p{L}]+)"), F.lit(1))).alias("index"))
    return words.groupBy(key, "index").agg(F.count("*").alias("value"))


def sparse_dot(spark, sf_dir):
    docs = _words(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), "id", "text")
    asked = _words(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), "query_id", "text")
    return op.sparse_search(asked, docs, k=5)


def vector_fetch(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").filter(F.col("lang") == "fr").select(F.col("doc_id").alias("id"))
    return op.fetch(_store(spark, sf_dir), ids).select("id", "label")


def vector_upsert(spark, sf_dir):
    store = _store(spark, sf_dir).select("id", "label", F.lit("old").alias("state"))
    labels = table(spark, sf_dir, "labels")
    n = F.col("doc_id")
    new = labels.select((n % 300).alias("id"), F.col("quality").alias("label"), F.lit("new").alias("state"), n.alias("version"))
    return op.upsert(store, new, "version")


def vector_delete(spark, sf_dir):
    store = _store(spark, sf_dir).select("id", "label", F.concat(F.lit("doc_"), F.floor(F.col("id") / 4)).alias("document_id"))
    ids = table(spark, sf_dir, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    docs = table(spark, sf_dir, "nation").select(F.concat(F.lit("doc_"), F.col("n_nationkey") * 2).alias("document_id"))
    return op.delete(store, ids=ids, where={"label": {"$in": [2, 7]}}, documents=docs)


def chunk_fixed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return text.chunk_text(docs, 1000, 100).select("doc_id", "chunk_id", "chunk_index", F.md5("content").alias("content_md5"), "start_index", "end_index")


def chunk_sentences(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return text.chunk_sentences(docs, 500).select("doc_id", "chunk_id", "chunk_index", F.md5("content").alias("content_md5"), "start_index", "end_index")


def hash_embedding(spark, sf_dir):
    out = embedding.hash_embed(_docs(spark, sf_dir))
    part = lambda i: F.round(F.element_at("embedding", i).cast("double"), 4)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return out.select("doc_id", F.size("embedding").alias("dim"), part(1).alias("first"), part(700).alias("middle"), part(1536).alias("last"), F.round(total, 3).alias("total"))


def embed_column(spark, sf_dir):
    chunks = text.chunk_text(_docs(spark, sf_dir), 800, 0)
    out = embedding.embed(chunks, embedding.HashEmbedder(256), "content", batch_size=64)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return out.select("chunk_id", F.size("embedding").alias("dim"), F.round(total, 3).alias("total"))


def _embed_sql(text_column, dim):
    """The embedding of a column as a DuckDB list, in float32 steps."""
    f = "CAST({} AS FLOAT)"
    code = f.format(f"unicode({text_column}[i + 1])")
    ramp = f"{f.format('i')} * CAST(0.001 AS FLOAT)"
    tail = f"{f.format(f'strlen({text_column}) * (i + 1)')} * CAST(0.001 AS FLOAT)"
    one = "CAST(1.0 AS FLOAT)"
    return f"""list_transform(range({dim}), lambda i: CASE WHEN i < length({text_column})
        THEN fmod({code} + {ramp}, {one}) ELSE fmod({tail}, {one}) END)"""


DIM = 1536


def _index(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return op.build_index(docs, embedding.HashEmbedder(DIM), 1000, 100, metadata=["lang"])


def rag_index(spark, sf_dir):
    """Index the documents, then replace those that are labelled with a shortened copy."""
    docs = _docs(spark, sf_dir)
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    again = labelled.withColumn("text", F.concat(F.lit("v2 "), "text"))
    small = embedding.HashEmbedder(16)
    index = op.build_index(again, small, 1000, 100, op.build_index(docs, small, 1000, 100, metadata=["lang"]), metadata=["lang"])
    return index.select("document_id", F.col("id").alias("chunk_id"), F.col("metadata")["lang"].alias("lang"), F.md5("content").alias("content_md5"), F.size("embedding").alias("dim"))


def rag_query(spark, sf_dir):
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    out = op.rag_query(asked, _index(spark, sf_dir), embedding.HashEmbedder(DIM), k=5, threshold=0.7)
    return out.select("query_id", "rank", "document_id", "chunk_id", F.round("score", 4).alias("score"), F.md5("preview").alias("preview_md5"))


def rag_context(spark, sf_dir):
    """Packed context per query over the ten best chunks, as a retrieval call returns it."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = op.rag_query(asked, _index(spark, sf_dir), embedding.HashEmbedder(DIM), k=10, threshold=0.7)
    return op.pack_context(hits, 4000).select("query_id", "chunks", F.octet_length("context").alias("bytes"))


def context_pack(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("query_id"), F.col("doc_id").alias("rank"), F.col("text").alias("content"))
    packed = op.pack_context(docs, 20_000)
    return packed.select("query_id", "chunks", F.md5("context").alias("context_md5"), F.octet_length("context").alias("bytes"))


def document_list(spark, sf_dir):
    index = text.chunk_text(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text"), doc="document_id")
    return op.list_documents(index, offset=50, limit=40)


def metadata_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("long"), F.when(F.col("n_chars") > 2000, "yes")).alias("metadata"))
    return op.metadata_filter(docs, {"lang": "en", "long": "yes"}).select("doc_id")


def document_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("namespace", F.col("lang"))
    out = op.vector_filter(
        docs,
        where={"$or": [{"source": {"$in": ["src1", "src2", "src7"]}}, {"n_chars": {"$gte": 3000}}], "doc_id": {"$ne": 1}},
        where_document={"$contains": "the", "$not_contains": "zzz"},
        namespace="en",
    )
    return out.select("doc_id", "source", "n_chars")


QUERIES = {
    "vector_topk": vector_topk,
    "vector_topk_filtered": vector_topk_filtered,
    "cosine": cosine,
    "distances": distances,
    "query_by_id": query_by_id,
    "sparse_dot": sparse_dot,
    "vector_fetch": vector_fetch,
    "vector_upsert": vector_upsert,
    "vector_delete": vector_delete,
    "index_stats": lambda s, d: op.index_stats(_store(s, d)),
    "chunk_fixed": chunk_fixed,
    "chunk_sentences": chunk_sentences,
    "hash_embedding": hash_embedding,
    "embed_column": embed_column,
    "rag_index": rag_index,
    "rag_query": rag_query,
    "rag_context": rag_context,
    "context_pack": context_pack,
    "document_list": document_list,
    "metadata_filter": metadata_filter,
    "document_filter": document_filter,
}


def _chunks_sql(size, overlap, source="documents", doc="doc_id", content="text"):
    step = size - overlap
    return f"""ch AS (SELECT {doc} AS doc_id, CAST(i AS INTEGER) AS chunk_index, {doc} || '_chunk_' || i AS chunk_id,
        substr({content}, i * {step} + 1, {size}) AS content, CAST(i * {step} AS INTEGER) AS start_index,
        CAST(least(i * {step} + {size}, length({content})) AS INTEGER) AS end_index
        FROM (SELECT *, unnest(range(CASE WHEN length({content}) <= {size} THEN 1
            ELSE 1 + CAST(ceil((length({content}) - {size}) / {step}) AS BIGINT) END)) AS i FROM {source}))"""


_RAG_SQL = f"""WITH {_chunks_sql(1000, 100)},
    idx AS (SELECT doc_id, chunk_id, content, CAST({_embed_sql('content', DIM)} AS DOUBLE[]) AS embedding FROM ch),
    q AS (SELECT item_id AS query_id, CAST({_embed_sql('text', DIM)} AS DOUBLE[]) AS qv FROM benchmark),
    sc AS (SELECT query_id, doc_id, chunk_id, content, list_cosine_similarity(embedding, qv) AS score FROM q, idx),
    rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sc WHERE score >= 0.7)"""

_SENTENCES_SQL = """WITH RECURSIVE parts AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, s FROM (
        SELECT doc_id, n, regexp_replace(p, '^\\s+|\\s+$', '', 'g') AS s FROM (
            SELECT doc_id, unnest(string_split(text, '.')) AS p, generate_subscripts(string_split(text, '.'), 1) AS n FROM documents)) WHERE s <> ''),
    w AS (SELECT doc_id, i, s AS cur, 0 AS pos, 0 AS k, CAST(NULL AS VARCHAR) AS closed, 0 AS closed_at FROM parts WHERE i = 1
      UNION ALL
      SELECT doc_id, i, CASE WHEN full_ THEN s ELSE cur || '. ' || s END, CASE WHEN full_ THEN pos + strlen(cur) ELSE pos END,
        CASE WHEN full_ THEN k + 1 ELSE k END, CASE WHEN full_ THEN cur END, pos
      FROM (SELECT w.doc_id, p.i, p.s, w.cur, w.pos, w.k, strlen(w.cur) + strlen(p.s) + 2 > 500 AS full_
        FROM w JOIN parts p ON p.doc_id = w.doc_id AND p.i = w.i + 1)),
    fin AS (SELECT doc_id, k - 1 AS chunk_index, closed AS content, closed_at AS start_index FROM w WHERE closed IS NOT NULL
      UNION ALL SELECT doc_id, k, cur, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS last FROM w) WHERE last = 1)
    SELECT doc_id, doc_id || '_sent_chunk_' || chunk_index AS chunk_id, CAST(chunk_index AS INTEGER) AS chunk_index,
        md5(content) AS content_md5, CAST(start_index AS INTEGER) AS start_index, CAST(start_index + strlen(content) AS INTEGER) AS end_index FROM fin"""

ORACLE = {
    "vector_topk": f"WITH {_Q}, {_rank_sql(_COS, 'score DESC', where=f'{_COS} >= 0.05')} SELECT query_id, id, score, rank FROM r WHERE rank <= 10",
    "vector_topk_filtered": f"WITH {_Q}, {_rank_sql(_COS, 'score DESC', where='label = 3')} SELECT query_id, id, score, rank FROM r WHERE rank <= 5",
    "cosine": f"WITH {_Q} SELECT vec_id AS id, round({_COS}, 6) AS score FROM embeddings JOIN q ON query_id = label",
    "distances": f"WITH {_Q}, {_rank_sql(_L2, 'score')} SELECT query_id, id, score AS distance, rank, label FROM r WHERE rank <= 8",
    "query_by_id": f"""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id IN (SELECT max(vec_id) FROM embeddings GROUP BY label)),
        {_rank_sql(_COS, 'score DESC')} SELECT query_id, id, score, rank FROM r WHERE rank <= 4""",
    "sparse_dot": r"""WITH d AS (SELECT doc_id AS id, w, count(*) AS v FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents) GROUP BY 1, 2),
        b AS (SELECT item_id AS query_id, w, count(*) AS v FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM benchmark) GROUP BY 1, 2),
        s AS (SELECT query_id, id, CAST(sum(d.v * b.v) AS BIGINT) AS score FROM d JOIN b USING (w) GROUP BY 1, 2),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)
        SELECT query_id, id, score, rank FROM r WHERE rank <= 5""",
    "vector_fetch": "SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')",
    "vector_upsert": """WITH n AS (SELECT doc_id % 300 AS id, arg_max(quality, doc_id) AS label FROM labels GROUP BY 1)
        SELECT vec_id AS id, label, 'old' AS state FROM embeddings WHERE vec_id NOT IN (SELECT id FROM n) UNION ALL SELECT id, label, 'new' FROM n""",
    "vector_delete": """SELECT vec_id AS id, label, 'doc_' || (vec_id // 4) AS document_id FROM embeddings
        WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND label NOT IN (2, 7)
        AND vec_id // 4 NOT IN (SELECT n_nationkey * 2 FROM nation)""",
    "index_stats": """SELECT 'ns_' || label AS namespace, count(*) AS vectors, CAST(max(len(embedding)) AS INTEGER) AS dimension, 0 AS is_total FROM embeddings GROUP BY 1
        UNION ALL SELECT NULL, count(*), CAST(max(len(embedding)) AS INTEGER), 1 FROM embeddings""",
    "chunk_fixed": f"WITH {_chunks_sql(1000, 100)} SELECT doc_id, chunk_id, chunk_index, md5(content) AS content_md5, start_index, end_index FROM ch",
    "chunk_sentences": _SENTENCES_SQL,
    "hash_embedding": f"""WITH v AS (SELECT doc_id, {_embed_sql('text', DIM)} AS e FROM documents)
        SELECT doc_id, CAST(len(e) AS INTEGER) AS dim, round(CAST(e[1] AS DOUBLE), 4) AS first, round(CAST(e[700] AS DOUBLE), 4) AS middle,
        round(CAST(e[1536] AS DOUBLE), 4) AS last, round(list_sum(CAST(e AS DOUBLE[])), 3) AS total FROM v""",
    "embed_column": f"""WITH {_chunks_sql(800, 0)}, v AS (SELECT chunk_id, {_embed_sql('content', 256)} AS e FROM ch)
        SELECT chunk_id, CAST(len(e) AS INTEGER) AS dim, round(list_sum(CAST(e AS DOUBLE[])), 3) AS total FROM v""",
    "rag_index": f"""WITH d2 AS (SELECT doc_id, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'v2 ' || text ELSE text END AS text FROM documents),
        {_chunks_sql(1000, 100, 'd2')}
        SELECT CAST(doc_id AS VARCHAR) AS document_id, chunk_id, lang, md5(content) AS content_md5, 16 AS dim FROM ch JOIN d2 USING (doc_id)""",
    "rag_query": _RAG_SQL + """ SELECT query_id, rank, CAST(doc_id AS VARCHAR) AS document_id, chunk_id, round(score, 4) AS score,
        md5(substr(content, 1, 200)) AS preview_md5 FROM rk WHERE rank <= 5""",
    "rag_context": _RAG_SQL + """, run AS (SELECT *, sum(strlen(content)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM rk WHERE rank <= 10)
        SELECT query_id, count(*) AS chunks, CAST(sum(strlen(content)) + 2 * (count(*) - 1) AS INTEGER) AS bytes FROM run
        WHERE total + 2 * greatest(rank - 2, 0) <= 4000 GROUP BY 1""",
    "context_pack": """WITH n AS (SELECT lang || '/' || source AS query_id, text, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k
            FROM documents WHERE strlen(text) > 0),
        run AS (SELECT *, sum(strlen(text)) OVER (PARTITION BY query_id ORDER BY k) AS total FROM n)
        SELECT query_id, count(*) AS chunks, md5(string_agg(text, chr(10) || chr(10) ORDER BY k)) AS context_md5,
        CAST(sum(strlen(text)) + 2 * (count(*) - 1) AS INTEGER) AS bytes FROM run WHERE total + 2 * greatest(k - 2, 0) <= 20000 GROUP BY 1""",
    "document_list": "SELECT doc_id AS document_id FROM documents ORDER BY 1 LIMIT 40 OFFSET 50",
    "metadata_filter": "SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars > 2000",
    "document_filter": """SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND doc_id <> 1
        AND (source IN ('src1', 'src2', 'src7') OR n_chars >= 3000) AND contains(text, 'the') AND NOT contains(text, 'zzz')""",
}
