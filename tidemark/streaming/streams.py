"""Structured Streaming twins of the batch operators.

Event time drives everything; rows behind the watermark (ten minutes unless
said otherwise) are dropped. State lives in the RocksDB provider, see
``rocksdb``. Functions return streaming DataFrames; those with a sink start
and return the query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidemark.functions.embedding import Embedder
from tidemark.operators.audit import chain_content
from tidemark.operators.ordering import MICROS, micros, position_in_order
from tidemark.operators.ratelimit import RateConfig
from tidemark.operators.retrieval import build_index
from tidemark.operators.threats import DEFAULT_PATTERNS, ThreatPattern
from tidemark.sources.files import JSON_TIMES, write_audit
from tidemark.streaming.ordered import ChainProcessor, RateProcessor, ThreatProcessor

LATENESS = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Start stateful queries with the RocksDB store, then restore the setting."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def event_time(stream: DataFrame, column: str = "timestamp", lateness: str = LATENESS) -> DataFrame:
    """Event time as an instant (zone-less columns are read in the session zone) with a watermark."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


# ------------------------------------------------------------------- sinks


def append_to(stream: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet", **trigger) -> StreamingQuery:
    writer = stream.writeStream.outputMode("append").format(fmt).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start(sink)


def update_into(stream: DataFrame, sink: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Updated rows of each micro-batch under ``batch=<n>``; a repeated batch overwrites itself."""

    def save(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    writer = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, sink: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """Per key the row of the newest batch that touched it."""
    rows = spark.read.schema(schema + ", batch int").parquet(sink)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "batch").alias("_r")).select(
        *keys, "_r.*"
    ).drop("batch")


# --------------------------------------------------------------- audit, threats


def stream_audit(
    stream: DataFrame, sink: str, checkpoint: str, key: str = "id", log: str = "log_id", lateness: str = LATENESS, release: int = 60,
    content: Column | None = None, **trigger,
) -> StreamingQuery:
    """Append audit events to chained logs, each id once within the watermark.

    An entry joins its log's chain, in order of (timestamp, id), once the watermark has passed its slot of
    ``release`` seconds, so entries that arrive out of order are chained as the batch operator would. The last
    number and hash of a log are state, and the chain goes on from them in every later micro-batch.

    The sink is a log for ``read_audit`` (with ``CHAINED_SCHEMA``): a folder per micro-batch, below it one per day.
    A repeated micro-batch overwrites its own folder.
    """
    schema = ", ".join(f"{name} {kind}" for name, kind in stream.dtypes)
    parts = stream.select(
        F.to_json(F.struct(log)).alias("log"), key, "timestamp", (content if content is not None else chain_content()).alias("content"),
        F.to_json(F.struct(*stream.columns), JSON_TIMES).alias("entry"))
    timed = event_time(parts, lateness=lateness).dropDuplicatesWithinWatermark([key])
    timed = timed.select("log", key, "timestamp", micros(F.col("timestamp")).alias("at_us"), "content", "entry")
    chained = timed.groupBy("log").transformWithStateInPandas(
        ChainProcessor(key, dict(stream.dtypes)[key], release),
        "log string, entry string, seq bigint, previous_hash string, chain_hash string", "Append", "EventTime")

    def save(rows: DataFrame, batch: int) -> None:
        entries = rows.select(F.from_json("entry", schema, JSON_TIMES).alias("e"), "seq", "previous_hash", "chain_hash")
        links = ("seq", "previous_hash", "chain_hash")
        plain = entries.select(*[F.col(f"e.`{c}`") for c in stream.columns if c not in links], *links)
        write_audit(plain, f"{sink}/batch={batch}", mode="overwrite")

    writer = chained.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_counts(
    stream: DataFrame, source: str = "source", window: str = "5 minutes", slide: str | None = None, lateness: str = LATENESS
) -> DataFrame:
    """(source, window_start, window_end, events) over sliding or tumbling windows."""
    span = F.window("timestamp", window, slide or window)
    counted = event_time(stream, lateness=lateness).groupBy(source, span.alias("_w")).agg(F.count("*").alias("events"))
    return counted.select(source, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "events")


def stream_threats(
    stream: DataFrame, patterns: Sequence[ThreatPattern] = DEFAULT_PATTERNS, source: str = "source", lateness: str = LATENESS, release: int = 60
) -> DataFrame:
    """(source, slot, pattern, severity, detections, peak): every pattern with its own window, in one stateful operator.

    ``stream(timestamp, source, failed, bytes)``. A slot of ``release`` seconds is judged once the watermark has
    passed it; ``threat_totals`` of all slots is what the batch ``detect`` finds in the same rows.
    """
    kind = dict(stream.dtypes)[source]
    timed = event_time(stream, lateness=lateness).select(
        source, "timestamp", micros(F.col("timestamp")).alias("at_us"), "failed", F.col("bytes").cast("double").alias("bytes"))
    return timed.groupBy(source).transformWithStateInPandas(
        ThreatProcessor(patterns, source, release),
        f"{source} {kind}, slot timestamp_ntz, pattern string, severity string, detections bigint, peak double", "Append", "EventTime")


def threat_totals(slots: DataFrame, source: str = "source") -> DataFrame:
    """(source, pattern, severity, detections, peak) over stored slots."""
    return slots.groupBy(source, "pattern", "severity").agg(F.sum("detections").alias("detections"), F.max("peak").alias("peak"))


def stream_sessions(stream: DataFrame, key: str = "source", gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Sessions that end after an idle gap: (key, opened, closed, events)."""
    grouped = event_time(stream, lateness=lateness).groupBy(key, F.session_window("timestamp", gap).alias("_s"))
    return grouped.agg(F.count("*").alias("events")).select(
        key, F.col("_s.start").alias("opened"), F.col("_s.end").alias("closed"), "events"
    )


def stream_counters(stream: DataFrame, kind: str = "kind", interval: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    return stream_counts(stream, kind, interval, lateness=lateness).drop("window_end")


# -------------------------------------------------------------- stateful


def stream_rate_limit(
    stream: DataFrame, config: RateConfig = RateConfig(), client: str = "client_id", tie: str = "id", lateness: str = LATENESS, release: int = 60
) -> DataFrame:
    """(client, id, verdict) as in the batch operator, in order of (timestamp, id) over all micro-batches.

    Requests wait in state until the watermark has passed their slot of ``release`` seconds.
    """
    kinds = dict(stream.dtypes)
    timed = event_time(stream, lateness=lateness).select(client, tie, "timestamp", micros(F.col("timestamp")).alias("at_us"))
    return timed.groupBy(client).transformWithStateInPandas(
        RateProcessor(config, client, tie, kinds[tie], release),
        f"{client} {kinds[client]}, {tie} {kinds[tie]}, verdict string",
        "Append",
        "EventTime",
    )


class TtlProcessor(StatefulProcessor):
    """Newest value of a key; a timer drops it once the watermark is past its expiry."""

    def __init__(self, key: str, ttl_seconds: int):
        self.key, self.ttl = key, ttl_seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("entry", "value string, at_us bigint")

    def handleInputRows(self, key, rows, timerValues):
        value, at = (self.state.get() if self.state.exists() else (None, None))
        changed = False
        for batch in rows:
            newest = batch.loc[batch["at_us"].idxmax()]
            if at is None or newest["at_us"] >= at:
                value, at, changed = newest["value"], int(newest["at_us"]), True
        if changed:
            self.state.update((value, at))
            self.handle.registerTimer(at // 1000 + self.ttl * 1000)
            yield pd.DataFrame({self.key: [key[0]], "value": [value], "created_us": [at], "expires_us": [at + self.ttl * MICROS]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # a newer value has its own, later timer
        if self.state.exists() and self.state.get()[1] // 1000 + self.ttl * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def stream_ttl_store(stream: DataFrame, ttl_seconds: int, key: str = "key", at: str = "created_at", lateness: str = LATENESS) -> DataFrame:
    """Changes of the store: (key, value, created_us, expires_us), newest value per key.

    Expiry follows event time, so that replays give the same store.
    """
    kind = dict(stream.dtypes)[key]
    timed = event_time(stream, at, lateness).select(key, "value", at, micros(F.col(at)).alias("at_us"))
    return timed.groupBy(key).transformWithStateInPandas(
        TtlProcessor(key, ttl_seconds),
        f"{key} {kind}, value string, created_us bigint, expires_us bigint",
        "Update",
        "EventTime",
    )


class ConversationProcessor(StatefulProcessor):
    """The newest n messages of a conversation; with ``idle_ms``, until so long after the newest of them."""

    def __init__(self, n: int, idle_ms: int | None):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", "turn bigint, role string, text string")
        self.newest = handle.getValueState("newest", "at_ms bigint")

    def handleInputRows(self, key, rows, timerValues):
        kept = list(self.messages.get()) if self.messages.exists() else []
        last = self.newest.get()[0] if self.newest.exists() else None
        for batch in rows:  # never more than n plus one Arrow batch
            if self.idle_ms is not None:
                batch = batch.sort_values("at_us", kind="stable")
                at = batch["at_us"].to_numpy() // 1000
                before = np.maximum.accumulate(np.concatenate([[at[0] if last is None else last], at[:-1]]))
                gaps = np.flatnonzero(at - before > self.idle_ms)
                if len(gaps):  # what came before is forgotten, whether its timer has gone off or not
                    kept, batch = [], batch.iloc[int(gaps[-1]) :]
                last = int(max(before[-1], at[-1]))
            kept += list(zip(batch["turn"].tolist(), batch["role"], batch["text"]))
            kept = sorted(kept, key=lambda m: m[0])[-self.n :] if self.n else []
        if not kept:
            return
        self.messages.put([tuple(m) for m in kept])
        if self.idle_ms is not None:
            self.newest.update((last,))
            self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame(
            {"conv_id": [key[0]] * len(kept), "version": [int(kept[-1][0])] * len(kept), "turn": [int(m[0]) for m in kept],
             "role": [m[1] for m in kept], "text": [m[2] for m in kept]}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # a later message has its own, later timer
        if self.newest.exists() and self.newest.get()[0] + self.idle_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.messages.clear()
            self.newest.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def stream_conversation(
    stream: DataFrame, n: int = 10, at: str | None = None, idle_seconds: int = 30 * 86_400, lateness: str = LATENESS
) -> DataFrame:
    """After every change the newest ``n`` messages; ``version`` is the newest turn.

    With a time column ``at``, a conversation is forgotten ``idle_seconds`` of event time after its newest message.
    """
    kind = dict(stream.dtypes)["conv_id"]
    columns = ["conv_id", "turn", "role", "text"]
    if at:
        stream = event_time(stream, at, lateness).withColumn("at_us", micros(F.col(at)))
        columns += [at, "at_us"]
    return stream.select(*columns).groupBy("conv_id").transformWithStateInPandas(
        ConversationProcessor(n, idle_seconds * 1000 if at else None),
        f"conv_id {kind}, version bigint, turn bigint, role string, text string", "Update", "EventTime" if at else "None"
    )


def stream_batches(
    stream: DataFrame, sink: str, checkpoint: str, shard: str, size: int = 10,
    action: Callable[[DataFrame, int], DataFrame] | None = None, parts: int = 64, **trigger,
) -> StreamingQuery:
    """Run ``action`` on numbered groups of each micro-batch and save what it returns.

    Every row is delivered with its micro-batch, so a shard's last group may hold fewer than ``size`` rows.
    ``batch_no`` counts a shard's groups from 0 within the micro-batch, which the sink names as ``batch``. Rows
    are numbered by their hash, then by all columns that have an order, so that a repeated micro-batch makes the
    same groups; a busy shard is numbered in ``parts`` tasks.
    """
    if size < 1:
        raise ValueError("size must be positive")
    ordered = [c for c, kind in stream.dtypes if c != shard and "map<" not in kind and "variant" not in kind]
    part = F.pmod(F.xxhash64(*(ordered or [F.lit(0)])), F.lit(parts))

    def save(rows: DataFrame, batch: int) -> None:
        placed = position_in_order(rows, [shard], part, ordered or [F.lit(0)], "_place")
        grouped = placed.withColumn("batch_no", F.floor(F.col("_place") / size)).drop("_place")
        (action(grouped, batch) if action else grouped).write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


# --------------------------------------------------------------------- index


INDEX_PARTS = 64  # folders of a micro-batch's chunks, by a hash of the document


def _part_of(document: Column, parts: int = INDEX_PARTS) -> Column:
    return F.pmod(F.xxhash64(document.cast("string")), F.lit(parts)).cast("int")


def stream_index(
    stream: DataFrame, sink: str, checkpoint: str, embedder: Embedder | None = None, size: int = 1000, overlap: int = 100,
    metadata: Sequence[str] = (), doc: str = "doc_id", **trigger,
) -> StreamingQuery:
    """Chunk, embed and store new documents; a later batch replaces a document whole.

    A micro-batch is a folder, below it one folder for each part of the documents. Every document of the batch also
    leaves a mark (a row without id and chunk), so one that has no chunks any more, or null text, takes its older
    chunks away. A repeated micro-batch overwrites its own folder.
    """

    def save(docs: DataFrame, batch: int) -> None:
        index = build_index(docs, embedder, size, overlap, metadata=metadata, doc=doc)
        marks = docs.select(F.col(doc).cast("string").alias("document_id")).distinct()
        rows = index.unionByName(marks, allowMissingColumns=True).withColumn("part", _part_of(F.col("document_id")))
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{sink}/batch={batch}")

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _folders(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """{number: path} of the finished folders ``name=<number>`` below a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return {}
    found = {}
    for status in files.listStatus(at):
        folder = status.getPath()
        key, _, number = folder.getName().partition("=")
        if key == name and files.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            found[int(number)] = folder.toString()
    return found


def _index_rows(spark: SparkSession, sink: str) -> DataFrame:
    """All rows a reader needs, with ``batch``: the newest compacted folder and the micro-batches after it."""
    merged = _folders(spark, f"{sink}/_compacted", "upto")
    last = max(merged, default=-1)
    parts = [spark.read.parquet(merged[last])] if merged else []
    parts += [spark.read.parquet(path).withColumn("batch", F.lit(n)) for n, path in sorted(_folders(spark, sink, "batch").items()) if n > last]
    if not parts:
        raise FileNotFoundError(f"no index in {sink}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _newest_of(rows: DataFrame) -> DataFrame:
    newest = rows.groupBy(F.col("document_id").alias("_of")).agg(F.max("batch").alias("_last"))
    return rows.join(newest, F.col("document_id").eqNullSafe(F.col("_of")) & (F.col("batch") == F.col("_last")), "left_semi")


def read_index(spark: SparkSession, sink: str, documents: Sequence | None = None) -> DataFrame:
    """The stored index: of each document only the chunks of its newest batch.

    ``documents`` looks up these ids: of every folder only the parts that can hold them are read.
    """
    rows = _index_rows(spark, sink)
    if documents is not None:
        ids = [str(d) for d in documents]
        held = spark.createDataFrame([(i,) for i in ids], "id string").select(_part_of(F.col("id")).alias("p")).distinct().collect()
        rows = rows.filter(F.col("part").isin([r.p for r in held]) & F.col("document_id").isin(ids))
    return _newest_of(rows).filter("id IS NOT NULL").drop("batch", "part")


def compact_index(spark: SparkSession, sink: str) -> int | None:
    """Merge all finished micro-batches into one folder and drop what it replaces; returns the last batch in it.

    Marks without chunks and replaced documents go. Readers take the newest finished folder, so one that is
    interrupted does no harm. Not to be run while another compaction of the same index runs.
    """
    batches = _folders(spark, sink, "batch")
    merged = _folders(spark, f"{sink}/_compacted", "upto")
    last = max(merged, default=-1)
    new = [n for n in batches if n > last]
    if new:
        whole = _newest_of(_index_rows(spark, sink)).filter("id IS NOT NULL")
        whole.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{sink}/_compacted/upto={max(new)}")
        last = max(new)
    for n, path in [*batches.items(), *merged.items()]:
        if path != merged.get(last) or n != last:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            if n <= last:
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return None if last < 0 else last
