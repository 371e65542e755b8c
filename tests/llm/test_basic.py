"""Sharding and exact deduplication against plain Python."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, sharding

DOCS = "doc_id long, text string, lang string, shard string, kept int"


def jump(key, n):
    b, j, k = -1, 0, int(hashlib.md5(str("" if key is None else key).encode()).hexdigest()[:16], 16)
    while j < n:
        b, k = j, (k * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


def edge_rows():
    return [(1, "Abc é", "en", "x", 7), (2, "aBC é", "en", "x", 7), (3, "aBC É", None, None, None), (4, None, "en", "x", 1),
            (5, "", "en", "x", 1), (6, "word " * 200_000, "en", "x", 1), (None, "abc é", "en", "x", 1), (8, "only", "en", "x", 1),
            (8, "only", "en", "x", 1), (9, "  ", "en", "x", 1)]


def test_jump_hash_matches_the_published_loop(spark):
    df = spark.range(3000).select("id", *[sharding.jump_hash(F.col("id"), n).alias(f"n{n}") for n in (1, 2, 16, 17, 90)])
    for row in df.collect():
        assert [row[f"n{n}"] for n in (1, 2, 16, 17, 90)] == [jump(row.id, n) for n in (1, 2, 16, 17, 90)]


def test_shards_are_gapless_and_grow_only_into_the_new_one(spark):
    docs = spark.createDataFrame(edge_rows() + [(i, f"t{i}", "en", "x", 1) for i in range(10, 2000)], DOCS)
    rows = sharding.shard_documents(docs, 16, block_rows=10).collect()
    assert len(rows) == docs.count()
    for shard, n in Counter(r.shard for r in rows).items():
        assert 0 <= shard < 16
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    assert all(r.grown_shard in (r.shard, 16) and r.shard == jump(r.doc_id, 16) for r in rows)
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert all(r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) and r.size == len((texts[r.doc_id] or "").encode()) + 1
               for r in rows if r.doc_id is not None)
    assert sharding.shard_documents(docs.limit(0), 16).count() == 0
    assert set(sharding.assign_shards(docs, 4).columns) == set(docs.columns)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups_edges(spark, keep):
    docs = spark.createDataFrame(edge_rows(), DOCS)
    rows = exact_dedup.exact_groups(docs, keep=keep).collect()
    assert len(rows) == 10
    sizes = Counter(lower(r.text) for r in docs.collect())
    for r in rows:
        assert r.group_size == sizes[lower(r.text)]
        assert r.text_sha256 == hashlib.sha256(lower(r.text).encode()).hexdigest()
        ids = [x[0] for x in edge_rows() if lower(x[1]) == lower(r.text) and x[0] is not None]
        assert r.keep_id == (min if keep == "smallest" else max)(ids)
    assert Counter(r.keep_id for r in rows if r.kept) == Counter({i: 1 for i in {r.keep_id for r in rows}})
    out = exact_dedup.exact_dedup(docs, keep=keep)
    assert out.columns == docs.columns and out.count() == len(sizes)
    assert {r.kept for r in out.where("doc_id = 9").collect()} == {1}
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_equal_hash_is_not_equal_text(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b")], "doc_id long, text string")
    rows = exact_dedup.exact_groups(docs, hash128=lambda c: F.lit(b"\x00" * 16)).collect()
    assert {r.doc_id: r.keep_id for r in rows} == {1: 1, 2: 2, 3: 1, 4: 2}
