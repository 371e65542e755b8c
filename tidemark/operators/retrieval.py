"""Exact vector search, vector tables, sparse scores and context packing."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.embedding import Embedder, embed
from tidemark.functions.text import chunk_text
from tidemark.operators.ordering import first_n
from tidemark.session import cut_lineage

# ------------------------------------------------------------- pair scores


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0.0 when lengths differ or a norm is zero."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (scale == 0.0), 0.0).otherwise(_dot(a, b) / scale)


def squared_l2(a: Column, b: Column) -> Column:
    diffs = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(diffs, F.lit(0.0), lambda s, x: s + x * x)


# ------------------------------------------------------------------- top k

QUERY_ROWS = 20_000  # queries in a block
STORE_ROWS = 100_000  # store rows in a block
BLOCK_BYTES = 32 << 20  # of a block's vectors as doubles
PAIRS = 4_000_000  # scores a task holds at a time (32 MB as doubles)


def _by_length(vectors: Sequence) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    lengths = np.array([len(v) for v in vectors])
    out = {}
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        out[int(n)] = (rows, np.stack([np.asarray(vectors[i], dtype=np.float64) for i in rows]))
    return out


def _scores(queries, store, metric: str) -> np.ndarray:
    """Scores (queries x store rows), larger is better."""
    q_groups, s_groups = _by_length(queries), _by_length(store)
    missing = 0.0 if metric == "cosine" else -np.inf
    out = np.full((len(queries), len(store)), missing)
    for n, (s_rows, s) in s_groups.items():
        if n not in q_groups or n == 0:
            continue
        q_rows, q = q_groups[n]
        dots = q @ s.T
        if metric == "cosine":
            scale = np.outer(np.sqrt((q * q).sum(1)), np.sqrt((s * s).sum(1)))
            with np.errstate(divide="ignore", invalid="ignore"):
                values = np.where(scale == 0.0, 0.0, dots / scale)
        else:
            values = -np.maximum((q * q).sum(1)[:, None] + (s * s).sum(1)[None, :] - 2.0 * dots, 0.0)
        out[np.ix_(q_rows, s_rows)] = values
    return out


def _best(q_ids, q_vecs, s_ids: np.ndarray, s_vecs, k: int, floor: float | None, metric: str, pairs: int = PAIRS) -> pd.DataFrame:
    """Top k store rows per query of a block, ties by id, NaN last; at most ``pairs`` scores exist at a time."""
    wide = max(1, min(len(s_ids), 8192))
    high = max(1, pairs // wide)
    kept = []
    for q in range(0, len(q_ids), high):
        best = None
        for s in range(0, len(s_ids), wide):
            tile = _tile(q_ids[q : q + high], q_vecs[q : q + high], s_ids[s : s + wide], s_vecs[s : s + wide], k, floor, metric)
            if best is not None:
                tile = pd.concat([best, tile], ignore_index=True)
                tile = tile.assign(_key=tile["score"].fillna(-np.finfo(float).max)).sort_values(["_key", "id"], ascending=[False, True])
                tile = tile.drop(columns="_key").groupby("query_id", sort=False).head(k)
            best = tile
        kept.append(best)
    return pd.concat(kept, ignore_index=True)


def _exact(q: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Scores summed in the order of the dimensions, so that no tiling can change a bit of them."""
    if metric == "cosine":
        scale = np.sqrt(np.cumsum(q * q)[-1]) * np.sqrt(np.cumsum(rows * rows, axis=1)[:, -1])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(scale == 0.0, 0.0, np.cumsum(rows * q, axis=1)[:, -1] / scale)
    return -np.cumsum((rows - q) ** 2, axis=1)[:, -1]


def _tile(q_ids, q_vecs, s_ids: np.ndarray, s_vecs, k: int, floor: float | None, metric: str) -> pd.DataFrame:
    """Fast scores choose what can be among the best, exact ones decide."""
    scores = _scores(q_vecs, s_vecs, metric)
    keys = np.where(np.isnan(scores), -np.finfo(float).max, scores)
    size = max((float(np.dot(v, v)) for v in (*map(np.asarray, q_vecs), *map(np.asarray, s_vecs)) if len(v)), default=0.0)
    slack = 1e-9 * (1.0 + (size if np.isfinite(size) and metric == "l2" else 0.0))
    ids, qs, values = [], [], []
    for qi in range(len(q_ids)):
        row, q = keys[qi], np.asarray(q_vecs[qi], dtype=np.float64)
        usable = row > -np.inf
        if floor is not None:
            # a threshold drops what is below it; NaN is not below
            usable &= (row >= floor - slack) | np.isnan(scores[qi])
        at = np.flatnonzero(usable)
        if len(at) > k:
            cut = np.partition(row[at], len(at) - k)[len(at) - k]
            at = at[row[at] >= cut - slack]
        found = scores[qi, at]
        same = np.array([len(s_vecs[i]) == len(q) and len(q) > 0 for i in at], bool)
        if same.any():
            found[same] = _exact(q, np.stack([np.asarray(s_vecs[i], dtype=np.float64) for i in at[same]]), metric)
        if floor is not None:
            keep = (found >= floor) | np.isnan(found)
            at, found = at[keep], found[keep]
        order = np.lexsort((s_ids[at], -np.where(np.isnan(found), -np.finfo(float).max, found)))[:k]
        ids.append(s_ids[at[order]])
        values.append(found[order])
        qs += [q_ids[qi]] * len(order)
    return pd.DataFrame({"query_id": qs, "id": np.concatenate(ids), "score": np.concatenate(values)})


def vector_search(
    queries: DataFrame,
    store: DataFrame,
    k: int = 10,
    threshold: float | None = None,
    filters: Mapping[str, object] | None = None,
    metric: str = "cosine",
    where: Mapping[str, object] | None = None,
    where_document: Mapping[str, str] | None = None,
    namespace: str | None = None,
    query_rows: int = QUERY_ROWS,
    store_rows: int = STORE_ROWS,
) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` best store rows for every query.

    ``queries(query_id, embedding)``, ``store(id, embedding, ...)``. Scores are compared as they are, ties by
    id. For ``metric="l2"`` the score is the squared distance, smaller is closer. ``filters`` takes equal
    values, ``where``, ``where_document`` and ``namespace`` what ``vector_filter`` takes.

    Queries and store are cut into blocks of at most about ``query_rows`` and ``store_rows`` rows, fewer where
    vectors are long (``BLOCK_BYTES``), and meet block by block, whatever their size. A task holds one pair of
    blocks and a bounded tile of their scores, and emits k rows for each query and store block. Stored vectors of
    a length that no query has travel without their values.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric: {metric}")
    if filters:
        store = metadata_filter(store, filters)
    store = vector_filter(store, where, where_document, namespace)
    queries = queries.select("query_id", "embedding")
    q_kind, s_kind = dict(queries.dtypes)["query_id"], dict(store.dtypes)["id"]
    schema = f"query_id {q_kind}, id {s_kind}, score double"
    # a distance threshold is an upper bound on the squared distance
    floor = threshold if threshold is None or metric == "cosine" else -threshold

    # written once, so that counting the queries does not compute them again
    queries = cut_lineage(queries)
    lengths = {r[0]: r[1] for r in queries.groupBy(F.size("embedding")).count().collect()}  # a row for each length of a query
    fitting = max(1, BLOCK_BYTES // (8 * max(1, *lengths, 1)))
    q_blocks = max(1, math.ceil(sum(lengths.values()) / min(query_rows, fitting)))
    s_blocks = max(1, math.ceil(store.select("id").count() / min(store_rows, fitting)))  # counted before vectors are computed
    # null vectors are left out in the blocks: a filter here would be pushed down and compute every vector twice
    useful = F.col("embedding").isNull() | F.size("embedding").isin([n for n in lengths if n is not None])
    store = store.select("id", F.when(useful, F.col("embedding")).otherwise(F.array().cast(dict(store.dtypes)["embedding"])).alias("embedding"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("_s", numbers(s_blocks))
    right = store.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(s_blocks)).cast("int")).withColumn("_q", numbers(q_blocks))

    def block(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        s = s[s["embedding"].notna()]
        if not len(q) or not len(s):
            return pd.DataFrame({"query_id": q["query_id"][:0], "id": s["id"][:0], "score": np.empty(0)})
        return _best(q["query_id"].tolist(), q["embedding"].tolist(), s["id"].to_numpy(), s["embedding"].tolist(), k, floor, metric)

    best = left.groupBy("_q", "_s").cogroup(right.groupBy("_q", "_s")).applyInPandas(block, schema)
    nan_last = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    ranked = first_n(best, ["query_id"], [nan_last.desc(), F.col("id")], k)
    if metric == "l2":
        ranked = ranked.withColumn("score", F.abs("score"))
    return ranked.select("query_id", "id", "score", "rank")


def vector_query(store: DataFrame, queries: DataFrame, include: Sequence[str] = (), k: int = 10, **options) -> DataFrame:
    """Nearest rows by squared distance, with the asked columns of the store; options as for ``vector_search``."""
    hits = vector_search(queries, store, k, metric="l2", **options).withColumnRenamed("score", "distance")
    return hits.join(store.select("id", *include), "id") if include else hits


def search_by_id(store: DataFrame, ids: DataFrame, k: int = 10, **options) -> DataFrame:
    """Stored vectors as queries; ``ids(id)``."""
    queries = fetch(store, ids).select(F.col("id").alias("query_id"), "embedding")
    return vector_search(queries, store, k, **options)


PRODUCTS = 100_000_000  # of a query's and a row's value, that are simply made
LEVELS = 48  # impact levels of a term: level i holds what is between 2**-i and 2**-(i+1) of its greatest value


def _impact(value: Column, most: Column) -> Column:
    """0 for a term's greatest values, one more for each halving."""
    return F.least(F.greatest(F.floor(-F.log2(F.abs(value) / most)), F.lit(0)), F.lit(LEVELS - 1)).cast("int")


def _sparse_scores(pairs: DataFrame, q: DataFrame, s: DataFrame) -> DataFrame:
    """Whole scores of (query_id, id) pairs, by the terms of the query."""
    terms = pairs.join(q.select("query_id", "index", "_q"), "query_id")
    return terms.join(s.select("id", "index", "_s"), ["id", "index"]).groupBy("query_id", "id").agg(F.sum(F.col("_q") * F.col("_s")).alias("score"))


def sparse_search(queries: DataFrame, store: DataFrame, k: int = 10, most_products: int = PRODUCTS) -> DataFrame:
    """(query_id, id, score, rank) by sparse dot product, over rows that share a term with the query.

    Both sides are long form: ``(query_id | id, index, value)``, one row per term. How many products all common
    terms make is counted first; up to ``most_products`` they are simply made and added up. Beyond that, with the
    same rows, what cannot be among the best is left out before the join: the ``k`` strongest rows of each
    term are scored first; a query's k-th score among them is a lower bound. Its most common terms that together
    cannot give half of that bound bring no rows of their own. Of the others, with U the sum of what they can give
    at most, a row that can still be among the best has one that gives at least the share (bound left) / U of its
    most. Terms are kept by impact level, so a query meets only the levels above its share, and a word that
    every row has does not bring every row. Pairs that pass are scored whole. Exact for values of any sign.
    """
    q = queries.select("query_id", "index", F.col("value").alias("_q")).filter("_q <> 0 AND NOT isnan(_q)")
    q = cut_lineage(q)
    asked_of = q.select("index").distinct()
    s = cut_lineage(store.select("id", "index", F.col("value").alias("_s")).filter("_s <> 0 AND NOT isnan(_s)").join(asked_of, "index", "left_semi"))
    size = F.abs("_s").cast("double")
    limits = cut_lineage(s.groupBy("index").agg(
        F.max("_s").cast("double").alias("_max"), F.min("_s").cast("double").alias("_min"), F.max(size).alias("_most"), F.count(F.lit(1)).alias("_rows")))
    best = lambda scores: first_n(scores, ["query_id"], [F.desc("score"), F.col("id")], k)
    products = q.groupBy("index").count().join(limits, "index").agg(F.sum(F.col("count") * F.col("_rows"))).first()[0]
    if (products or 0) <= most_products:
        scores = s.join(q, "index").groupBy("query_id", "id").agg(F.sum(F.col("_q") * F.col("_s")).alias("score"))
        return best(scores).select("query_id", "id", "score", "rank")
    gives = F.greatest(F.col("_q") * F.col("_max"), F.col("_q") * F.col("_min"), F.lit(0.0))
    terms = q.join(limits, "index").withColumn("_gives", gives)
    first = first_n(s, ["index"], [size.desc(), F.col("id")], k, "_r").drop("_r")
    seeds = first.join(q.select("query_id", "index"), "index").select("query_id", "id").distinct()
    kth = first_n(_sparse_scores(seeds, q, s), ["query_id"], [F.desc("score"), F.col("id")], k, "_r").filter(F.col("_r") == k)
    bounds = kth.select("query_id", F.greatest(F.col("score").cast("double"), F.lit(0.0)).alias("_bound"))
    known = terms.join(bounds, "query_id", "left").withColumn("_bound", F.coalesce("_bound", F.lit(0.0)))
    commonest = Window.partitionBy("query_id").orderBy(F.desc("_rows"), "index").rowsBetween(Window.unboundedPreceding, 0)
    small = F.col("_gives") <= F.col("_bound") / 2
    known = known.withColumn("_left_out", small & (F.sum(F.when(small, F.col("_gives")).otherwise(0.0)).over(commonest) <= F.col("_bound") / 2))
    every = Window.partitionBy("query_id")
    given_up = F.sum(F.when(F.col("_left_out"), F.col("_gives")).otherwise(0.0)).over(every)
    can_give = F.sum(F.when(F.col("_left_out"), 0.0).otherwise(F.col("_gives"))).over(every)
    # a little less, as sums of doubles may differ in the last bits
    share = F.when((F.col("_bound") > 0) & (can_give > 0), (F.col("_bound") - given_up) / can_give * (1 - 1e-9)).otherwise(F.lit(0.0))
    known = known.withColumn("_share", F.least(share, F.lit(1.0))).withColumn("_need", F.col("_share") * F.col("_gives"))
    # what a term must give, as the least size of the stored value, and so the last level that can hold it
    deepest = F.when(F.col("_need") > 0, _impact(F.col("_need") / F.abs("_q"), F.col("_most"))).otherwise(F.lit(LEVELS - 1))
    useful = known.filter(~F.col("_left_out") & ((F.col("_gives") > 0) | (F.col("_share") == 0)))
    useful = useful.withColumn("_level", F.explode(F.sequence(F.lit(0), deepest)))
    levels = s.join(limits.select("index", "_most"), "index").withColumn("_level", _impact(F.col("_s").cast("double"), F.col("_most"))).drop("_most")
    met = levels.join(useful.select("query_id", "index", "_level", "_q", "_need", "_share"), ["index", "_level"])
    pairs = met.filter((F.col("_share") == 0) | (F.col("_q") * F.col("_s") >= F.col("_need"))).select("query_id", "id").distinct()
    return best(_sparse_scores(pairs, q, s)).select("query_id", "id", "score", "rank")


# ------------------------------------------------------------ vector tables


def fetch(store: DataFrame, ids: DataFrame, namespace: str | None = None) -> DataFrame:
    if namespace is not None:
        store = store.filter(F.col("namespace") == namespace)
    return store.join(ids.select("id").distinct(), "id", "left_semi")


def upsert(store: DataFrame, rows: DataFrame, version: str | None = None, key: str = "id") -> DataFrame:
    """Insert or replace by key.

    Of several new rows of a key the newest ``version`` wins; without one, and among equal versions, the row
    that is greatest column by column.
    """
    whole = [F.to_json(c) if kind.startswith("map") else F.col(c) for c, kind in ((c, dict(rows.dtypes)[c]) for c in store.columns)]
    rank = F.struct(*([F.col(version)] if version else []), *whole)
    fresh = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), rank).alias("r")).select("r.*").select(*store.columns)
    return store.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def delete(
    store: DataFrame, ids: DataFrame | None = None, where: Mapping[str, object] | None = None,
    documents: DataFrame | None = None, where_document: Mapping[str, str] | None = None, text: str = "text",
) -> DataFrame:
    """What remains after deleting by id, by filters on fields or text, or whole documents with their chunks.

    A row goes if it fits any of them.
    """
    for name, value in (where_document or {}).items():
        store = store.filter(~F.coalesce(_OPERATORS[name](F.col(text), value), F.lit(False)))
    if ids is not None:
        store = store.join(ids.select("id").distinct(), "id", "left_anti")
    if where:
        store = store.filter(~F.coalesce(where_condition(store, where), F.lit(False)))
    if documents is not None:
        store = store.join(documents.select("document_id").distinct(), "document_id", "left_anti")
    return store


def index_stats(store: DataFrame) -> DataFrame:
    """Vectors and dimension per namespace, and the total under a null namespace."""
    return store.rollup("namespace").agg(
        F.count("*").alias("vectors"),
        F.max(F.size("embedding")).alias("dimension"),
        F.grouping("namespace").cast("int").alias("is_total"),
    )


def list_documents(index: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    return index.select("document_id").distinct().orderBy("document_id").offset(offset).limit(limit)


# ------------------------------------------------------------------ filters


def _field(df: DataFrame, name: str) -> Column:
    if name in df.columns:
        return F.col(name)
    return F.try_element_at(F.col("metadata"), F.lit(name))


def metadata_filter(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Every key must exist and equal the wanted value."""
    for name, wanted in filters.items():
        df = df.filter(F.coalesce(_field(df, name) == F.lit(wanted), F.lit(False)))
    return df


_OPERATORS = {
    "$eq": lambda c, v: c == F.lit(v),
    "$ne": lambda c, v: c != F.lit(v),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
    "$contains": lambda c, v: c.contains(v),
    "$not_contains": lambda c, v: ~c.contains(v),
}


def where_condition(df: DataFrame, where: Mapping[str, object]) -> Column:
    """AND of ``{field: value}`` or ``{field: {op: value}}``, with ``$and`` / ``$or`` lists."""
    out = F.lit(True)
    for name, wanted in where.items():
        if name in ("$and", "$or"):
            parts = [where_condition(df, w) for w in wanted]
            part = parts[0]
            for p in parts[1:]:
                part = part & p if name == "$and" else part | p
        elif isinstance(wanted, Mapping):
            part = F.lit(True)
            for op, value in wanted.items():
                part = part & _OPERATORS[op](_field(df, name), value)
        else:
            part = _field(df, name) == F.lit(wanted)
        out = out & part
    return out


def vector_filter(
    df: DataFrame, where: Mapping[str, object] | None = None, where_document: Mapping[str, str] | None = None,
    namespace: str | None = None, text: str = "text",
) -> DataFrame:
    if namespace is not None:
        df = df.filter(F.col("namespace") == namespace)
    if where:
        df = df.filter(where_condition(df, where))
    for op, value in (where_document or {}).items():
        df = df.filter(_OPERATORS[op](F.col(text), value))
    return df


# --------------------------------------------------------- document retrieval


def build_index(
    docs: DataFrame, embedder: Embedder | None = None, size: int = 1000, overlap: int = 100,
    existing: DataFrame | None = None, doc: str = "doc_id", text: str = "text", metadata: Sequence[str] = (),
) -> DataFrame:
    """Chunk and embed documents; documents already indexed are replaced whole."""
    pairs = [c for name in metadata for c in (F.lit(name), F.col(name).cast("string"))]
    tags = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    named = docs.select(F.col(doc).cast("string").alias("document_id"), F.col(text), tags.alias("metadata"))
    chunks = chunk_text(named, size, overlap, "document_id", text).withColumnRenamed("chunk_id", "id")
    index = embed(chunks, embedder, "content")
    if existing is None:
        return index
    kept = existing.join(named.select("document_id").distinct(), "document_id", "left_anti")
    return kept.unionByName(index)


def rag_query(
    queries: DataFrame, index: DataFrame, embedder: Embedder | None = None, k: int = 10, threshold: float | None = None,
    filters: Mapping[str, object] | None = None,
) -> DataFrame:
    """(query_id, rank, document_id, chunk_id, score, preview, content); ``queries(query_id, text)``."""
    asked = embed(queries.select("query_id", "text"), embedder, "text")
    hits = vector_search(asked, index, k, threshold, filters)
    return hits.join(index.select("id", "document_id", "content"), "id").select(
        "query_id", "rank", "document_id", F.col("id").alias("chunk_id"), "score",
        F.left("content", F.lit(200)).alias("preview"), "content",
    )


def pack_context(results: DataFrame, max_len: int, group: str = "query_id", rank: str = "rank", content: str = "content") -> DataFrame:
    """(group, chunks, context): ranked contents joined by a blank line up to ``max_len`` bytes.

    Chunk k is taken while ``sum of lengths(1..k) + 2 * max(k - 2, 0) <= max_len``.
    Every chunk has at least one byte, so only the first ``(max_len + 4) / 3``
    can ever count; the rest of a large group is dropped before the shuffle.
    """
    some = results.filter(F.octet_length(content) > 0).select(group, rank, content)
    bound = max(2, (max_len + 4) // 3)
    numbered = first_n(some, [group], [F.col(rank)], bound, "_k")
    total = F.expr(f"sum(octet_length(`{content}`)) OVER (PARTITION BY `{group}` ORDER BY _k ROWS UNBOUNDED PRECEDING)")
    fits = numbered.withColumn("_total", total).filter(
        F.col("_total") + 2 * F.greatest(F.col("_k") - 2, F.lit(0)) <= max_len
    )
    return fits.groupBy(group).agg(
        F.count("*").alias("chunks"),
        F.expr(f"listagg(`{content}`, '\\n\\n') WITHIN GROUP (ORDER BY _k)").alias("context"),
    )
