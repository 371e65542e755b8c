"""Connected components as a converging series of Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges; the root is the smallest node that can be reached.

    Alternates large stars (every larger neighbour is tied to the smallest one) and small stars (every smaller
    neighbour is) until nothing changes, which takes about log(n) rounds. A round writes its edges to the
    shared folder and removes the round before; hub nodes send one minimum per task, and the join back has a
    plain exchange on both sides, so that a hub can be split.
    """
    spark = edges.sparkSession
    now = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    seen = _state(now)
    while seen[0]:
        pairs = _both_ways(now)
        least = stored(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
        large = stored(
            pairs.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi > lo").distinct(),
            "edges",
        )
        small_least = stored(large.groupBy("hi").agg(F.min("lo").alias("m")), "minima")
        tied = large.join(small_least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi > lo")
        following = stored(tied.union(small_least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        state = _state(following)
        forget(spark, now, least, large, small_least)
        now = following
        if state == seen:
            break
        seen = state
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
