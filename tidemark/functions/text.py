"""Text columns: chunks, line views, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Trim any whitespace, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def chunk_text(df: DataFrame, size: int = 1000, overlap: int = 100, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Character windows of ``size``, each starting ``size - overlap`` after the last.

    Adds chunk_id, chunk_index, content, start_index and end_index; other
    columns are kept, the text is not. A null text has no chunks. Narrow: no shuffle.
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    n = F.char_length(text)
    last = (F.ceil((n - size) / step) * step).cast("int")
    starts = F.when(n <= size, F.array(F.lit(0))).when(n > size, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step)))
    rest = [c for c in df.columns if c != text]
    # cut before they are rows, so that no chunk carries the whole text
    chunks = F.transform(starts, lambda at: F.struct(at.alias("start"), F.substring(F.col(text), at + 1, F.lit(size)).alias("content")))
    return df.select(*rest, F.posexplode(chunks).alias("chunk_index", "_chunk")).select(
        *rest,
        F.concat(F.col(doc).cast("string"), F.lit("_chunk_"), F.col("chunk_index")).alias("chunk_id"),
        "chunk_index",
        F.col("_chunk.content").alias("content"),
        F.col("_chunk.start").alias("start_index"),
        (F.col("_chunk.start") + F.char_length("_chunk.content")).alias("end_index"),
    )


def chunk_sentences(df: DataFrame, size: int = 1000, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences packed greedily up to ``size`` bytes, joined by ``". "``.

    Offsets accumulate the byte lengths of the finished chunks.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    sentences = F.filter(F.transform(F.split(text, r"\."), strip), lambda s: s != "")
    # only numbers are carried along the sentences: which chunks are done (first sentence, how many, offset) and,
    # for the open one, its first sentence, its bytes and its offset
    done_type = "array<struct<first:int,many:int,start:int>>"
    begin = F.struct(
        F.array().cast(done_type).alias("done"), F.lit(0).alias("first"), F.lit(0).alias("bytes"), F.lit(0).alias("at"), F.lit(0).alias("n"))

    def chunk(acc: Column) -> Column:
        return F.array(F.struct(acc["first"].alias("first"), (acc["n"] - acc["first"]).alias("many"), acc["at"].alias("start")))

    def add(acc: Column, more: Column) -> Column:
        full = (acc["bytes"] > 0) & (acc["bytes"] + more + 2 > size)
        return F.struct(
            F.when(full, F.concat(acc["done"], chunk(acc))).otherwise(acc["done"]).alias("done"),
            F.when(full, acc["n"]).otherwise(acc["first"]).alias("first"),
            F.when(full | (acc["bytes"] == 0), more).otherwise(acc["bytes"] + 2 + more).alias("bytes"),
            F.when(full, acc["at"] + acc["bytes"]).otherwise(acc["at"]).alias("at"),
            (acc["n"] + 1).alias("n"),
        )

    def close(acc: Column) -> Column:
        return F.when(acc["bytes"] == 0, acc["done"]).otherwise(F.concat(acc["done"], chunk(acc)))

    def cut(c: Column) -> Column:
        return F.struct(F.array_join(F.slice("_sentences", c["first"] + 1, c["many"]), ". ").alias("content"), c["start"].alias("start"))

    rest = [c for c in df.columns if c != text]
    split = df.select(*rest, sentences.alias("_sentences"))
    ends = F.aggregate(F.transform("_sentences", F.octet_length), begin, add, close)
    packed = split.select(*rest, "_sentences", ends.alias("_ends")).select(*rest, F.transform("_ends", cut).alias("chunks"))
    # outer: else Spark asks first whether there are chunks, and computes all of this once more for every chunk
    return packed.select(*rest, F.posexplode_outer("chunks").alias("chunk_index", "chunk")).filter("chunk IS NOT NULL").select(
        *rest,
        F.concat(F.col(doc).cast("string"), F.lit("_sent_chunk_"), F.col("chunk_index")).alias("chunk_id"),
        "chunk_index",
        F.col("chunk.content").alias("content"),
        F.col("chunk.start").alias("start_index"),
        (F.col("chunk.start") + F.octet_length("chunk.content")).alias("end_index"),
    )
