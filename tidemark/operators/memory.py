"""Key-value memory with expiry, bounded conversations, sessions, prompt cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import first_n, micros, moment, newest


def is_live(now) -> Column:
    """No expiry, or not yet past it (the instant itself is still live)."""
    return F.col("expires_at").isNull() | (moment(now) <= F.col("expires_at"))


def not_expired(df: DataFrame, now) -> DataFrame:
    return df.filter(is_live(now))


def memory_stats(df: DataFrame, now) -> DataFrame:
    live = is_live(now)
    return df.agg(
        F.count("*").alias("total_entries"),
        F.count_if(live).alias("active_entries"),
        F.count_if(~live).alias("expired_entries"),
        F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("total_size_bytes"),
    )


def evict(df: DataFrame, max_entries: int, now, key: str = "key") -> DataFrame:
    """What stays before one more entry is written: expired ones go, then the
    oldest until fewer than ``max_entries`` are left.

    The cut is found from counts per minute of creation; only the minute it
    falls into is ranked.
    """
    return newest(not_expired(df, now), micros(F.col("created_at")), key, max_entries - 1)


# ------------------------------------------------------------ conversations


def message_line() -> Column:
    return F.concat(F.col("role"), F.lit(": "), F.col("text"))


def search_messages(df: DataFrame, term: str) -> DataFrame:
    """Messages with the term in text or role, whatever the case, as ``role: text``."""
    wanted = F.lower(F.lit(term))
    hit = F.lower("text").contains(wanted) | F.lower("role").contains(wanted)
    return df.filter(hit).select("conv_id", "turn", message_line().alias("line"))


def last_messages(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` messages of each conversation; none for 0."""
    return first_n(df, ["conv_id"], [F.desc("turn")], n, "_age").drop("_age")


def transcript(df: DataFrame) -> DataFrame:
    """One ``role: text`` line per message, in order, per conversation."""
    return (
        df.withColumn("_line", message_line())
        .groupBy("conv_id")
        .agg(F.count("*").alias("messages"), F.expr("listagg(_line, '\\n') WITHIN GROUP (ORDER BY turn)").alias("transcript"))
    )


def conversation_stats(df: DataFrame) -> DataFrame:
    """Messages, bytes, participants and a role-to-count map per conversation."""
    per_role = df.groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    return per_role.groupBy("conv_id").agg(
        F.sum("n").alias("total_messages"),
        F.sum("bytes").alias("total_characters"),
        F.count("*").alias("participants"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "n")))).alias("role_counts"),
    )


# ------------------------------------------------------------------ sessions


def session_summary(df: DataFrame, session: str = "session_id", at: str = "timestamp") -> DataFrame:
    return df.groupBy(session).agg(
        F.min(at).alias("created_at"), F.max(at).alias("last_activity"), F.count("*").alias("message_count")
    )


def active_sessions(df: DataFrame, now, idle_hours: int | None = None) -> DataFrame:
    """Sessions with ``active``: not past expiry, and not idle longer than allowed.

    ``df(session_id, timestamp, expires_at)``; a session's expiry is the one of
    its newest row, null means it has none.
    """
    last = df.groupBy("session_id").agg(
        F.max(F.struct("timestamp", "expires_at")).alias("_last")
    ).select("session_id", F.col("_last.timestamp").alias("last_activity"), F.col("_last.expires_at").alias("expires_at"))
    active = is_live(now)
    if idle_hours is not None:
        active = active & (F.col("last_activity") >= moment(now) - F.expr(f"INTERVAL {int(idle_hours)} HOURS"))
    return last.withColumn("active", active)


# --------------------------------------------------------------- prompt cache


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("prompt_hash", F.xxhash64("prompt"))


def cache_lookup(prompts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with ``result``, misses); matched by hash and by the text itself."""
    asked = _hashed(prompts)
    stored = cache.select("prompt_hash", "prompt", "result")
    hits = asked.join(stored, ["prompt_hash", "prompt"])
    misses = asked.join(stored, ["prompt_hash", "prompt"], "left_anti")
    return hits, misses


def cache_store(results: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """The cache with the new (prompt, result) rows; a stored prompt is replaced."""
    fresh = _hashed(results.select("prompt", "result")).groupBy("prompt_hash", "prompt").agg(F.max("result").alias("result"))
    if cache is None:
        return fresh
    kept = cache.select("prompt_hash", "prompt", "result").join(fresh, ["prompt_hash", "prompt"], "left_anti")
    return kept.unionByName(fresh)
