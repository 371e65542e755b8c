"""Shards by jump consistent hashing, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import replace_columns, stored, text_or_empty

# Multiplier of the published generator, in 16-bit limbs from low to high: 2862933555777941757.
_M = [2862933555777941757 >> s & 0xFFFF for s in (0, 16, 32, 48)]
_LOW = 0xFFFFFFFF
_STATE = T.StructType([T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()),
                       T.StructField("b", T.LongType()), T.StructField("j", T.LongType())])


def key_halves(key: Column) -> tuple[Column, Column]:
    """64 bits of the key's MD5 as two numbers of 32 bits, so that neighbouring keys start far apart."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long"))


def _step(state: Column, shards: int) -> Column:
    """One jump: state * multiplier + 1 modulo 2**64 in limbs that cannot overflow, then the next bucket."""
    hi, lo, b, j = (state[name] for name in ("hi", "lo", "b", "j"))
    high = lo * _M[1]
    low = lo * _M[0] + F.shiftleft(high.bitwiseAND(0xFFFF), 16) + 1
    top = (
        F.shiftright(low, 32) + F.shiftright(high, 16) + lo * _M[2] + F.shiftleft((lo * _M[3]).bitwiseAND(0xFFFF), 16)
        + hi * _M[0] + F.shiftleft((hi * _M[1]).bitwiseAND(0xFFFF), 16)
    ).bitwiseAND(_LOW)
    jump = F.floor((j + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(top, 1) + 1).cast("double")))
    moved = F.struct(top.alias("hi"), low.bitwiseAND(_LOW).alias("lo"), j.alias("b"), jump.cast("long").alias("j"))
    return F.when(j < shards, moved).otherwise(F.struct(hi.alias("hi"), lo.alias("lo"), b.alias("b"), j.alias("j")))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a key, 0 to ``shards`` - 1. With one shard more, keys move only into the new one.

    The number of jumps is about ln(shards), and never more than ``shards``; the rare key that is not done
    after 32 jumps goes on for as many as it can take.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    hi, lo = key_halves(key)
    zero = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    at_first = min(shards, 32)
    state = F.aggregate(F.sequence(F.lit(1), F.lit(at_first)), zero.cast(_STATE), lambda s, _: _step(s, shards))
    if shards > at_first:
        rest = F.aggregate(F.sequence(F.lit(at_first + 1), F.lit(shards)), state, lambda s, _: _step(s, shards))
        state = F.when(state["j"] < shards, rest).otherwise(state)
    return state["b"].cast("int")


def shard_documents(
    docs: DataFrame, shards: int, id: str = "doc_id", text: str = "text", block_rows: int = 100_000
) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot and grown_shard (the shard if there were one more).

    The id and the shard count alone decide the shard. Slots number the rows of a shard from 0 without gaps:
    rows are cut into blocks of about ``block_rows`` by a hash, numbered inside their block, and moved by
    the rows of the blocks before; no task orders a whole shard.

    Null text has no bytes (size 1). Null ids go to one fixed shard. Repeated rows get slots of their own.
    Only id and text are read, so other columns cannot clash. An empty table gives an empty result.
    """
    raw = text_or_empty(text)
    placed = docs.select(F.col(id).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"),
                         F.crc32(raw).alias("text_crc32"))
    placed = placed.withColumns({"shard": jump_hash(F.col("doc_id"), shards), "grown_shard": jump_hash(F.col("doc_id"), shards + 1)})
    placed = stored(placed, "shards")
    blocks = max(1, placed.count() // (shards * block_rows))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(blocks)).cast("int"))
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.withColumn("place", F.row_number().over(inside) - 1)
    return numbered.join(starts, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("place")).cast("long").alias("slot"), "grown_shard",
    )


def assign_shards(docs: DataFrame, shards: int, id: str = "doc_id", column: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row; a narrow operation, to be followed by partitioned writes."""
    return replace_columns(docs, [column]).withColumn(column, jump_hash(F.col(id), shards))
