"""Registered queries of the training-data operators, with SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    best_fit, decontaminate, exact_dedup, hard_negatives, html_main, lm_score, packing, periodic, quality, sharding, simhash, suffix_dedup, token_store,
)
from tidemark.session import table


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix_dedup.remove_repeats(docs, length=50)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


TOKENIZER, WORD_TOKENIZER = "byte_bpe_50k.json", "word_bpe_49k.json"


def _tokenizer() -> str:
    """Where the installed package of public vocabularies keeps its file; asked for by the task that reads it."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_TOKENIZER)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = token_store.write_store(docs, _tokenizer, end_id=0)
    return token_store.read_boundaries(spark.read.parquet(path))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good and not toxic; background: all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    # labels grow with the documents: a merge join at every size, never a broadcast
    return lm_score.token_cross_entropy_difference(docs, docs.join(good.hint("merge"), "doc_id", "left_semi"), _tokenizer)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, _tokenizer, end_id=1, window=2048)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_groups(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


EXACT_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_groups(docs, width=4, max_bits=4).select("doc_id", "fingerprint", "component_id")


def _planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's tenth of documents that repeat part of themselves to the end."""
    import zlib

    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [*words[:a], *(words[a : a + p] * ((len(words) - a) // p + 1))[: len(words) - a]]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.periodic_runs(docs, min_length=24, min_periods=3, rewrite=_planted_period)
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return best_fit.pack_best_fit(docs, _word_tokenizer, end_id=0, window=2048)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh vector is given the next label first, as the contract has it."""
    vectors = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0)


HARD_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
o AS (SELECT * FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT o.anchor_id, o.other AS positive_id, p.other AS negative_id, o.score AS positive_score, p.score AS negative_score
    FROM o JOIN p ON o.anchor_id = p.anchor_id AND NOT p.same AND 30 * o.score <= 100 * p.score AND 100 * p.score <= 90 * o.score)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank,
    negative_id, positive_score, negative_score FROM n QUALIFY rank <= 10
"""


QUERIES = {
    "op2_suffix_dedup": op2_suffix_dedup,
    "op4_lm_score": op4_lm_score,
    "op1_decontaminate": op1_decontaminate,
    "op7_html_main": op7_html_main,
    "op6_quality": op6_quality,
    "op8_packing": op8_packing,
    "op3_token_store": op3_token_store,
    "op9_simhash": op9_simhash, "op5_sharding": op5_sharding, "op10_exact_dedup": op10_exact_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_best_fit": op12_best_fit,
    "op13_periodic_runs": op13_periodic_runs}
ORACLE = {"op10_exact_dedup": EXACT_SQL, "op11_hard_negatives": HARD_SQL}
