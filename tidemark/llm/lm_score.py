"""Cross-entropy difference of two n-gram models over one vocabulary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, text_or_empty
from tidemark.llm.tokens import encode_column, id_encoder

#: Models of ``cross_entropy_difference`` are trigrams over UTF-8 bytes: any text is covered, and a table has at most 256 ** 3 counts.
SYMBOLS = 256
CHUNK = 4 << 20


def trigrams(text: str):
    """Codes of a text's trigrams: one per byte, with the two bytes before it (zero before the start)."""
    data = np.concatenate([np.zeros(2, np.uint8), np.frombuffer(text.encode(), np.uint8)]).astype(np.int32)
    return (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n) over all rows. A task sends a row for each gram it has met; sums are combined before the shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(SYMBOLS**3, np.int64)
        held, size = [], 0

        def add():
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            total[grams] += n

        for batch in batches:
            for value in batch.column(0):
                codes = trigrams(value.as_py())
                for at in range(0, len(codes), CHUNK):
                    held.append(codes[at : at + CHUNK])
                    size += len(held[-1])
                    if size >= CHUNK:
                        add()
                        held, size = [], 0
        if held:
            add()
        seen = np.flatnonzero(total)
        for at in range(0, len(seen), 100_000):
            part = seen[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["gram", "n"])

    counted = docs.select(text_or_empty(text).alias("text")).mapInArrow(run, "gram int, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def losses(grams, counts, weight: float = 4.0):
    """Negative log2 probability of every trigram's last byte.

    Each order is smoothed with ``weight`` counts of the order below, the lowest with one count per symbol.
    """
    three = np.zeros(SYMBOLS**3, np.float32)
    three[grams] = counts
    two_exact = np.bincount(grams & 0xFFFF, counts, SYMBOLS**2)
    one_exact = np.bincount(grams & 0xFF, counts, SYMBOLS)
    one = (one_exact + 1) / (one_exact.sum() + SYMBOLS)
    two = two_exact.reshape(SYMBOLS, SYMBOLS)
    before_one = two.sum(axis=1, keepdims=True)
    two = (two + weight * one) / (before_one + weight)
    three = three.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    before_two = three.sum(axis=2, dtype=np.float64)[:, :, None].astype(np.float32)
    three += (weight * two).astype(np.float32)[None, :, :]
    three /= before_two + np.float32(weight)
    np.log2(three, out=three)
    return np.negative(three, out=three).reshape(-1)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, tokens, target_loss, background_loss, difference) for every row; lower differences are nearer to the target.

    The background model counts all of ``docs``, the target model all of ``target``. Both have the same order,
    the same vocabulary and the same smoothing, so losses (bits per byte) are comparable token by token; the
    difference is their mean over the whole text. Only the tables of counts, bounded by the vocabulary, reach
    the driver and travel with the tasks.

    Null text counts as empty; an empty text has zero losses. Without target rows the target model is uniform.
    Repeated rows count as often as they come. Other columns are not read.
    """
    spark = docs.sparkSession
    tables = []
    for source, column in ((target, target_text), (docs, text)):
        table = trigram_counts(source, column).toPandas()
        tables.append((table["gram"].to_numpy(np.int32), table["n"].to_numpy(np.int64)))
    sent = spark.sparkContext.broadcast(tables)
    kind = dict(docs.dtypes)[id]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        models = None
        for batch in batches:
            models = models or [losses(*t) for t in sent.value]
            out = np.zeros((3, batch.num_rows))
            for row, value in enumerate(batch.column(1)):
                codes = trigrams(value.as_py())
                n = len(codes)
                out[:, row] = (n, *(float(m[codes].sum(dtype=np.float64)) / max(1, n) for m in models))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0].astype(np.int64)), pa.array(out[1]), pa.array(out[2]), pa.array(out[1] - out[2])],
                ["doc_id", "tokens", "target_loss", "background_loss", "difference"])

    rows = docs.select(F.col(id).alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, tokens long, target_loss double, background_loss double, difference double")


#: Losses of single bigrams are whole numbers of this part of a bit, so that sums do not depend on their order.
PART = 1 << 20
#: Ids of a chunk: documents that a task encodes one after the other and that send their bigrams together.
CHUNK_IDS = 2 << 20


def _codes(ids):
    """Bigrams of the ids of a text, coded as (id before + 1) << 32 | id. The first id follows 0."""
    codes = ids.astype(np.int64)
    codes[1:] |= (codes[:-1] + 1) << 32
    return codes


def bigrams(docs: DataFrame, tokenizer: str | Callable[[], str], id: str, text: str, keep_ids: bool = True) -> DataFrame:
    """(chunk, doc_id, tokens, id_bytes, ids, grams, counts): the ids of every text, little-endian (null without ``keep_ids``).

    A chunk's last row holds the distinct bigrams of all its texts; those of the other rows are empty.
    """
    kind = dict(docs.dtypes)[id]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode, dtype = id_encoder(tokenizer if isinstance(tokenizer, str) else tokenizer())
        width = np.dtype(dtype).itemsize
        parts, ids, held = [], [], 0

        def ready():
            grams, counts = np.unique(np.concatenate([_codes(np.frombuffer(x, dtype)) for x in ids]), return_counts=True)
            ends = pa.array([0] * len(ids) + [len(grams)], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (grams, counts.astype(np.int32))]
            row, doc_id = (pa.concat_arrays([p.column(i) for p in parts]) for i in (0, 1))
            return pa.RecordBatch.from_arrays(
                [pa.array([row[0].as_py()] * len(ids), pa.int64()), doc_id, pa.array([len(x) // width for x in ids], pa.int64()),
                 pa.array([width] * len(ids), pa.int32()), pa.array(ids if keep_ids else [None] * len(ids), pa.binary()), *lists],
                ["chunk", "doc_id", "tokens", "id_bytes", "ids", "grams", "counts"])

        for batch in batches:
            first = 0
            encoded = (own for part in encode_column(encode, batch.column(2), b"") for own in part.to_pylist())
            for at, own in enumerate(encoded, 1):
                ids.append(own)
                held += len(ids[-1]) // width + 8  # so that empty texts end a chunk too
                if held >= CHUNK_IDS:
                    parts.append(batch.slice(first, at - first).select([0, 1]))
                    yield ready()
                    first, parts, ids, held = at, [], [], 0
            if first < batch.num_rows:
                parts.append(batch.slice(first).select([0, 1]))
        if ids:
            yield ready()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, f"chunk long, doc_id {kind}, tokens long, id_bytes int, ids binary, grams array<long>, counts array<int>")


def _each(coded: DataFrame, *keys: str) -> DataFrame:
    return coded.select(*keys, F.explode(F.arrays_zip("grams", "counts")).alias("g")).select(*keys, F.col("g.grams").alias("gram"), F.col("g.counts").alias("n"))


def bigram_losses(background: DataFrame, target: DataFrame, weight: float = 4.0) -> DataFrame:
    """(gram, target_part, background_part) from the tables (gram, n) of both models, for the grams of the background.

    Bigrams are smoothed with ``weight`` counts of single ids, these with one count per id of the vocabulary: all
    ids of both tables. Losses are in parts of a bit.
    """
    both = background.withColumnRenamed("n", "n_b").join(target.withColumnRenamed("n", "n_t"), "gram", "full")
    both = stored(both.select("gram", F.coalesce("n_b", F.lit(0)).alias("n_b"), F.coalesce("n_t", F.lit(0)).alias("n_t")), "bigrams")
    parted = both.withColumn("before", F.shiftright("gram", 32)).withColumn("id", F.col("gram").bitwiseAND((1 << 32) - 1))
    before = parted.groupBy("before").agg(F.sum("n_b").alias("before_b"), F.sum("n_t").alias("before_t"))
    single = parted.groupBy("id").agg(F.sum("n_b").alias("id_b"), F.sum("n_t").alias("id_t"))
    size, all_b, all_t = single.agg(F.count(F.lit(1)), F.coalesce(F.sum("id_b"), F.lit(0)), F.coalesce(F.sum("id_t"), F.lit(0))).first()

    def part(of: str, total: int):
        one = (F.col(f"id_{of}") + 1) / F.lit(float(total + size))
        two = (F.col(f"n_{of}") + F.lit(weight) * one) / (F.col(f"before_{of}") + F.lit(weight))
        return F.round(-F.log2(two) * PART).cast("long")

    known = parted.where("n_b > 0").join(before, "before").join(single, "id")
    return known.select("gram", part("t", all_t).alias("target_part"), part("b", all_b).alias("background_part"))


def token_cross_entropy_difference(
    docs: DataFrame, target: DataFrame, tokenizer: str | Callable[[], str], id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """(doc_id, tokens, target_loss, background_loss, difference) as above, by bigrams of tokenizer ids, in bits per id.

    Counts of all bigrams of ``docs`` and ``target`` are Spark tables, combined in each task before the shuffle;
    they grow with the corpus. Documents meet them chunk by chunk: a row for each distinct bigram of a chunk is
    joined to both models and goes back to its chunk, where the losses of every document are summed. So no table
    of counts reaches the driver or travels whole with a task, a bigram has at most one row for each chunk, and a
    task holds one chunk (about two million ids, or one longer text) at a time. Null text counts as empty; an
    empty text has zero losses. Repeated rows count as often as they come. Other columns are not read.
    """
    coded = stored(bigrams(docs, tokenizer, id, text), "document-bigrams")
    aimed = bigrams(target.withColumn("_none", F.lit(0)), tokenizer, "_none", target_text, keep_ids=False)
    tables = [_each(c).groupBy("gram").agg(F.sum("n").alias("n")) for c in (coded, aimed)]
    # the grams of chunks grow with the input as the model does: a merge join at every size
    known = _each(coded, "chunk").join(bigram_losses(*tables).hint("merge"), "gram")
    known = known.select(F.col("chunk").alias("of"), "gram", "target_part", "background_part")

    def score(documents, losses):
        import pyarrow as pa

        doc_id, tokens, width, packed = (documents.column(c).combine_chunks() for c in ("doc_id", "tokens", "id_bytes", "ids"))
        gram, *parts = (losses.column(c).to_numpy() for c in ("gram", "target_part", "background_part"))
        order = np.argsort(gram)
        gram, parts = gram[order], [p[order] for p in parts]
        dtype = f"<u{width[0].as_py()}"
        sums = np.zeros((2, len(packed)), np.int64)
        for row, data in enumerate(packed):
            place = np.searchsorted(gram, _codes(np.frombuffer(data.as_buffer(), dtype)))
            sums[:, row] = [p[place].sum() for p in parts]
        return pa.table([doc_id, tokens, pa.array(sums[0]), pa.array(sums[1])], ["doc_id", "tokens", "t", "b"])

    texts = coded.select("chunk", "doc_id", "tokens", "id_bytes", "ids")
    kind = dict(texts.dtypes)["doc_id"]
    sums = texts.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(score, f"doc_id {kind}, tokens long, t long, b long")
    per = lambda c: F.col(c) / F.lit(float(PART)) / F.greatest("tokens", F.lit(1))
    out = sums.select("doc_id", "tokens", per("t").alias("target_loss"), per("b").alias("background_loss"))
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
