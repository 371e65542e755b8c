"""Streaming queries: the tables as file streams, run until all rows are seen."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.embedding import HashEmbedder
from tidemark.plans.access import _WINDOWED_SQL, PATTERNS, RATES
from tidemark.plans.access import ORACLE as ACCESS_SQL
from tidemark.plans.audit import _CHAIN_SQL
from tidemark.plans.retrieval import _chunks_sql
from tidemark.plans.views import SQL_STAMP, audit_entries, stamp
from tidemark.session import fresh_path, table
from tidemark.sources.files import AUDIT_SCHEMA, read_audit
from tidemark.streaming import streams as st

LATE = "40 days"  # the shared events come in one unordered file


def _stream(spark, sf_dir, name):
    """The table as a stream; it may be one file or a folder of files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _events(spark, sf_dir):
    return _stream(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("user_id").alias("source"), "event_type",
        "value", (F.col("event_type") == "error").alias("failed"), F.col("value").alias("bytes"), "props",
    )


def _paths(spark, label):
    return fresh_path(spark, label), fresh_path(spark, label + "-ckpt")


def _released(ts: str = "ts") -> str:
    """SQL for rows whose slot of a day the last watermark has passed."""
    return f"(epoch_us({ts}) // 86400000000 + 1) * 86400000000 <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events)"


DAY, HELD = 86_400, "1 hour"  # slots and lateness of the streams that put rows in order


def stream_audit(spark, sf_dir):
    """Every event comes twice; the chained log of each user keeps it once."""
    sink, ckpt = _paths(spark, "audit")
    entries = audit_entries(_stream(spark, sf_dir, "events")).withColumn("log_id", F.col("user_id"))
    twice = entries.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    with st.rocksdb(spark):
        st.stream_audit(twice, sink, ckpt, lateness=HELD, release=DAY).awaitTermination()
    log = read_audit(spark, sink, AUDIT_SCHEMA + ", log_id bigint, seq bigint")
    return log.select("log_id", "id", stamp("timestamp").alias("at"), "event_type", "seq", "previous_hash", "chain_hash")


def stream_threats(spark, sf_dir):
    sink, ckpt = _paths(spark, "threats")
    with st.rocksdb(spark):
        found = st.stream_threats(_events(spark, sf_dir), PATTERNS, lateness=HELD, release=DAY)
        st.append_to(found, sink, ckpt).awaitTermination()
    slots = spark.read.schema("source bigint, slot timestamp_ntz, pattern string, severity string, detections bigint, peak double").parquet(sink)
    return st.threat_totals(slots).withColumn("peak", F.round("peak", 4))


def stream_rate_limit(spark, sf_dir):
    sink, ckpt = _paths(spark, "rate")
    requests = _events(spark, sf_dir).select(F.col("source").alias("client_id"), "id", "timestamp")
    with st.rocksdb(spark):
        st.append_to(st.stream_rate_limit(requests, RATES, lateness=HELD, release=DAY), sink, ckpt).awaitTermination()
    return spark.read.schema("client_id bigint, id bigint, verdict string").parquet(sink)


def stream_ttl_store(spark, sf_dir):
    sink, ckpt = _paths(spark, "ttl")
    entries = _events(spark, sf_dir).select(F.concat(F.lit("k"), "source").alias("key"), F.col("props").alias("value"), F.col("timestamp").alias("created_at"))
    with st.rocksdb(spark):
        st.update_into(st.stream_ttl_store(entries, 3600, lateness=LATE), sink, ckpt).awaitTermination()
    return st.latest(spark, sink, "key string, value string, created_us bigint, expires_us bigint", ["key"])


def stream_conversation(spark, sf_dir):
    sink, ckpt = _paths(spark, "conversation")
    with st.rocksdb(spark):
        st.update_into(st.stream_conversation(_stream(spark, sf_dir, "conversations"), 4), sink, ckpt).awaitTermination()
    rows = spark.read.parquet(sink)
    newest = rows.groupBy("conv_id").agg(F.max("version").alias("version"))
    return rows.join(newest, ["conv_id", "version"], "left_semi").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def stream_sessions(spark, sf_dir):
    """Sessions closed by the watermark: those ended two days before the last event."""
    sink, ckpt = _paths(spark, "sessions")
    st.append_to(st.stream_sessions(_events(spark, sf_dir), gap="6 hours", lateness="2 days"), sink, ckpt).awaitTermination()
    return spark.read.parquet(sink).select("source", stamp("opened").alias("opened"), stamp("closed").alias("closed"), "events")


def stream_counters(spark, sf_dir):
    sink, ckpt = _paths(spark, "counters")
    kinds = _events(spark, sf_dir).withColumnRenamed("event_type", "kind")
    st.update_into(st.stream_counters(kinds, interval="6 hours", lateness=LATE), sink, ckpt).awaitTermination()
    out = st.latest(spark, sink, "kind string, window_start timestamp, events bigint", ["kind", "window_start"])
    return out.select("kind", stamp("window_start").alias("window_start"), "events")


def stream_batches(spark, sf_dir):
    """Totals over groups of ten rows per user, the last of a user with what is left."""
    sink, ckpt = _paths(spark, "batches")
    rows = _events(spark, sf_dir).select("source", "id")
    totals = lambda df, _: df.groupBy("source", "batch_no").agg(F.count("*").alias("rows"))
    st.stream_batches(rows, sink, ckpt, "source", 10, totals).awaitTermination()
    return spark.read.parquet(sink).select("source", "batch_no", "rows")


def stream_index(spark, sf_dir):
    sink, ckpt = _paths(spark, "index")
    docs = _stream(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    st.stream_index(docs, sink, ckpt, HashEmbedder(16), metadata=["lang"]).awaitTermination()
    out = st.read_index(spark, sink)
    return out.select("document_id", F.col("id").alias("chunk_id"), F.md5("content").alias("content_md5"), F.size("embedding").alias("dim"))


QUERIES = {
    "stream_audit": stream_audit,
    "stream_threats": stream_threats,
    "stream_rate_limit": stream_rate_limit,
    "stream_ttl_store": stream_ttl_store,
    "stream_conversation": stream_conversation,
    "stream_sessions": stream_sessions,
    "stream_counters": stream_counters,
    "stream_batches": stream_batches,
    "stream_index": stream_index,
}

ORACLE = {
    "stream_audit": _CHAIN_SQL + f""" SELECT c.log_id, c.id, strftime(a.timestamp, '{SQL_STAMP}') AS at, a.event_type, c.seq, c.previous_hash, c.chain_hash
        FROM chain c JOIN audit a USING (id) WHERE {_released("a.timestamp")}""",
    "stream_threats": _WINDOWED_SQL + f""", k AS (SELECT event_id AS id, {_released()} AS done, epoch_us(ts) // 21600000000 AS slot, user_id AS source FROM events),
        s AS (SELECT DISTINCT source, slot FROM k WHERE done)
        SELECT source, 'brute_force_login' AS pattern, 'High' AS severity, count(*) AS detections, CAST(max(attempts) AS DOUBLE) AS peak
            FROM b WHERE attempts >= 3 AND id IN (SELECT id FROM k WHERE done) GROUP BY 1
        UNION ALL SELECT source, 'rate_limit_abuse', 'Medium', count(*), max(requests) FROM r WHERE requests > 5 AND id IN (SELECT id FROM k WHERE done) GROUP BY 1
        UNION ALL SELECT source, 'data_exfiltration', 'High', count(*), round(max(total_bytes), 4) FROM x JOIN s USING (source, slot) GROUP BY 1""",
    "stream_rate_limit": f"WITH all_rows AS ({ACCESS_SQL['rate_decision']}) SELECT a.* FROM all_rows a JOIN events e ON e.event_id = a.id WHERE {_released('e.ts')}",
    "stream_ttl_store": """SELECT 'k' || user_id AS key, arg_max(props, ts) AS value, max(epoch_us(ts)) AS created_us, max(epoch_us(ts)) + 3600000000 AS expires_us
        FROM events GROUP BY 1""",
    "stream_conversation": """SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4""",
    "stream_sessions": f"""WITH g AS (SELECT user_id AS source, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g),
        t AS (SELECT source, min(ts) AS opened, max(ts) + INTERVAL 6 HOURS AS closed, count(*) AS events FROM s GROUP BY source, n)
        SELECT source, strftime(opened, '{SQL_STAMP}') AS opened, strftime(closed, '{SQL_STAMP}') AS closed, events FROM t
        WHERE epoch_ms(closed) <= (SELECT epoch_ms(max(ts)) - 172800000 FROM events)""",
    "stream_counters": f"""SELECT event_type AS kind, strftime(make_timestamp(epoch_us(ts) // 21600000000 * 21600000000), '{SQL_STAMP}') AS window_start, count(*) AS events
        FROM events GROUP BY 1, 2""",
    "stream_batches": """WITH c AS (SELECT user_id AS source, count(*) AS n FROM events GROUP BY 1),
        g AS (SELECT source, n, unnest(range((n + 9) // 10)) AS batch_no FROM c)
        SELECT source, batch_no, least(10, n - 10 * batch_no) AS rows FROM g""",
    "stream_index": f"""WITH {_chunks_sql(1000, 100)} SELECT CAST(doc_id AS VARCHAR) AS document_id, chunk_id, md5(content) AS content_md5, 16 AS dim FROM ch""",
}
