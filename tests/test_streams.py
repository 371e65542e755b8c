"""Streams over several micro-batches against their batch twins."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import audit, memory, ratelimit, threats
from tidemark.plans.access import RATES
from tidemark.plans.views import audit_entries
from tidemark.session import fresh_path, table
from tidemark.sources.files import AUDIT_SCHEMA, read_audit
from tidemark.streaming import streams as st


@pytest.fixture(scope="module")
def event_files(spark, sf_dir):
    """Events as eight files in time order, one per micro-batch."""
    path = fresh_path(spark, "event-files")
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("user_id").alias("client_id"))
    for part in range(8):
        day = F.dayofmonth("timestamp")
        events.filter((day > part * 4) & (day <= part * 4 + 4)).coalesce(1).write.mode("append").parquet(path)
    return path, events


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


LATE = "9 days"


@pytest.fixture(scope="module")
def mixed_files(spark, sf_dir):
    """Six micro-batches: events up to eight days out of order, then one row far ahead, then rows behind the watermark."""
    path = fresh_path(spark, "mixed-files")
    events = table(spark, sf_dir, "events").filter("user_id < 40").withColumn("part", F.floor((F.dayofmonth("ts") + F.pmod(F.hash("event_id"), F.lit(8))) / 10))
    for part in range(4):
        events.filter(F.col("part") == part).drop("part").orderBy(F.rand(part)).coalesce(1).write.mode("append").parquet(path)
    events = events.drop("part")
    ahead = events.limit(1).select(*[
        F.lit(10**9).cast("bigint").alias("event_id"), F.lit("2030-01-01").cast("timestamp_ntz").alias("ts"), F.lit(-1).cast("bigint").alias("user_id"),
        "event_type", "value", "props"])
    late = events.limit(5).withColumn("event_id", F.col("event_id") + 10**8)
    for extra in (ahead, late):
        extra.select(*events.columns).coalesce(1).write.mode("append").parquet(path)
    return path, events


def _entries(events):
    return audit_entries(events).withColumn("log_id", F.col("user_id"))


def test_rate_limit_puts_micro_batches_in_order(spark, mixed_files):
    path, events = mixed_files
    requests = lambda df: df.select(F.col("user_id").alias("client_id"), F.col("event_id").alias("id"), F.col("ts").alias("timestamp"))
    sink, ckpt = fresh_path(spark, "s"), fresh_path(spark, "c")
    with st.rocksdb(spark):
        found = st.stream_rate_limit(requests(_stream(spark, path, events.schema)), RATES, lateness=LATE, release=86_400)
        st.append_to(found, sink, ckpt).awaitTermination(300)
    rows = spark.read.parquet(sink).collect()
    want = {r["id"]: r["verdict"] for r in ratelimit.rate_limit(requests(events), RATES).collect()}
    assert len(rows) == len(want) and {r["id"]: r["verdict"] for r in rows} == want
    assert len(set(want.values())) > 2


def test_threats_by_default_equal_the_batch(spark, mixed_files):
    """Three detectors with windows of five, one and one minutes over a flood in the middle of the events."""
    path, events = mixed_files
    flood = events.limit(1).select(F.explode(F.sequence(F.lit(0), F.lit(399))).alias("n")).select(
        (F.col("n") + 2 * 10**8).cast("bigint").alias("event_id"),
        (F.lit("2024-01-15 10:00:30").cast("timestamp_ntz") + F.make_dt_interval(secs=F.floor(F.col("n") / 3) * 0.75)).alias("ts"),
        F.lit(7).cast("bigint").alias("user_id"), F.when(F.col("n") % 40 == 0, "error").otherwise("view").alias("event_type"),
        F.lit(50_000.25).alias("value"), F.lit("{}").alias("props"))
    whole = fresh_path(spark, "flooded")
    for df in (flood, *[spark.read.parquet(f) for f in sorted(spark.read.parquet(path).inputFiles())][:5]):
        df.select(*events.columns).coalesce(1).write.mode("append").parquet(whole)
    seen = lambda df: df.select(
        F.col("user_id").alias("source"), F.col("ts").alias("timestamp"), (F.col("event_type") == "error").alias("failed"), F.col("value").alias("bytes"))
    sink, ckpt = fresh_path(spark, "s"), fresh_path(spark, "c")
    with st.rocksdb(spark):
        st.append_to(st.stream_threats(seen(_stream(spark, whole, events.schema)), lateness="60 days"), sink, ckpt).awaitTermination(600)
    got = {(r.source, r.pattern, r.severity, r.detections, r.peak) for r in st.threat_totals(spark.read.parquet(sink)).collect()}
    rows = seen(events.unionByName(flood))
    want = {(r.source, r.pattern, r.severity, r.detections, r.peak) for r in threats.detect(rows, failed=F.col("failed")).collect()}
    assert got == want
    assert {p for _, p, *_ in got} == {p.id for p in threats.DEFAULT_PATTERNS}


def test_audit_chain_goes_on(spark, mixed_files):
    """Micro-batches out of order make one chain per log; a repeated micro-batch changes nothing."""
    import os

    path, events = mixed_files
    sink, ckpt = fresh_path(spark, "s"), fresh_path(spark, "c")

    def run():
        twice = _entries(_stream(spark, path, events.schema)).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
        with st.rocksdb(spark):
            st.stream_audit(twice, sink, ckpt, lateness=LATE, release=86_400).awaitTermination(600)
        return read_audit(spark, sink, AUDIT_SCHEMA + ", log_id bigint, seq bigint")

    log = run()
    links = ("log_id", "id", "seq", "previous_hash", "chain_hash")
    got = sorted(tuple(r) for r in log.select(*links).collect())
    want = sorted(tuple(r[c] for c in links) for r in audit.build_chain(_entries(events)).collect())
    assert got == want and log.select("batch").distinct().count() > 1
    assert audit.verify_chain(log).count() == 0
    assert log.filter("day = '2024-01-15'").count() == events.filter("to_date(ts) = '2024-01-15'").count()
    commits = sorted((int(n) for n in os.listdir(f"{ckpt}/commits") if n.isdigit()))
    written = sorted(log.select("batch").distinct().toPandas()["batch"])
    os.rename(f"{ckpt}/commits/{commits[-1]}", fresh_path(spark, "moved-commit"))
    crc = f"{ckpt}/commits/.{commits[-1]}.crc"
    if os.path.exists(crc):
        os.rename(crc, fresh_path(spark, "moved-crc"))
    again = run()
    assert sorted(tuple(r) for r in again.select(*links).collect()) == want
    assert sorted(again.select("batch").distinct().toPandas()["batch"]) == written


def test_conversation_over_micro_batches(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations")
    path, sink, ckpt = (fresh_path(spark, n) for n in ("talks", "s", "c"))
    for part in (0, 1, 2):
        talks.filter(F.col("turn") % 3 == part).coalesce(1).write.mode("append").parquet(path)
    with st.rocksdb(spark):
        st.update_into(st.stream_conversation(_stream(spark, path, talks.schema), 2), sink, ckpt).awaitTermination(120)
    rows = spark.read.parquet(sink)
    last = rows.groupBy("conv_id").agg(F.max("batch").alias("batch"))
    got = {(r[0], r[1]) for r in rows.join(last, ["conv_id", "batch"]).select("conv_id", "turn").collect()}
    want = {(r[0], r[1]) for r in memory.last_messages(talks, 2).select("conv_id", "turn").collect()}
    assert got == want


def test_conversations_are_forgotten(spark):
    """A message long after the last one starts a conversation anew; without expiry it would follow the old ones."""
    import datetime as dt

    day, schema = dt.datetime(2024, 1, 1), "conv_id long, turn long, role string, text string, at timestamp_ntz"
    path, sink, ckpt = (fresh_path(spark, n) for n in ("aging", "s", "c"))
    for days, conv, turn in ((0, 1, 1), (1, 1, 2), (60, 2, 1), (61, 1, 3)):
        spark.createDataFrame([(conv, turn, "user", f"t{turn}", day + dt.timedelta(days=days))], schema).coalesce(1).write.mode("append").parquet(path)
    with st.rocksdb(spark):
        st.update_into(st.stream_conversation(_stream(spark, path, schema), 5, at="at"), sink, ckpt).awaitTermination(120)
    versions = {}
    for r in spark.read.parquet(sink).filter("conv_id = 1").collect():
        versions.setdefault(r.version, []).append(r.turn)
    assert {v: sorted(t) for v, t in versions.items()} == {1: [1], 2: [1, 2], 3: [3]}


def test_late_rows_are_dropped(spark, tmp_path):
    import datetime as dt

    path, sink, ckpt = (fresh_path(spark, n) for n in ("late", "s", "c"))
    day = dt.datetime(2024, 1, 1)
    for hours in (10, 30, 1):
        spark.createDataFrame([("a", day + dt.timedelta(hours=hours))], "kind string, timestamp timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
    stream = _stream(spark, path, "kind string, timestamp timestamp_ntz")
    st.append_to(st.stream_counters(stream, interval="1 hour"), sink, ckpt).awaitTermination(120)
    assert [r["events"] for r in spark.read.parquet(sink).collect()] == [1]


def test_batches_deliver_every_row(spark, event_files):
    path, events = event_files
    sink, ckpt = fresh_path(spark, "s"), fresh_path(spark, "c")
    rows = _stream(spark, path, events.schema).select(F.when(F.col("client_id") % 2 == 0, F.col("client_id")).alias("client_id"), "id")
    st.stream_batches(rows, sink, ckpt, "client_id", 3, parts=4).awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.select("batch").distinct().count() > 1
    assert sorted(r["id"] for r in out.collect()) == sorted(r["id"] for r in events.collect())
    groups = out.groupBy("batch", "client_id", "batch_no").count()
    sizes = {}
    for r in groups.collect():
        sizes.setdefault((r["batch"], r["client_id"]), {})[r["batch_no"]] = r["count"]
    assert any(key is None for _, key in sizes)
    for own in sizes.values():
        assert sorted(own) == list(range(len(own)))
        assert all(n == 3 for i, n in own.items() if i < len(own) - 1) and own[len(own) - 1] <= 3


def test_index_over_micro_batches_and_compaction(spark):
    """Replaced, emptied and new documents; compacted in between, looked up by part, the newest batch always counts."""
    from tidemark.functions.embedding import HashEmbedder

    path, sink, ckpt = (fresh_path(spark, n) for n in ("docs", "s", "c"))
    schema = "doc_id long, text string"
    files = [[(i, f"first {i} " * 30) for i in range(40)], [(i, f"second {i}") for i in range(0, 40, 3)], [(5, None), (7, ""), (100, "new " * 200)]]
    state, embedder = {}, HashEmbedder(4)

    def grow(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        st.stream_index(_stream(spark, path, schema), sink, ckpt, embedder, size=50, overlap=0).awaitTermination(120)
        state.update(dict(rows))

    def check():
        want = {}
        for i, t in state.items():
            for n in range(0, max(len(t), 1), 50) if t is not None else ():
                want[f"{i}_chunk_{n // 50}"] = t[n : n + 50]
        assert {r.id: r.content for r in st.read_index(spark, sink).collect()} == want
        for some in ([5], [7, 12, 100], [999]):
            got = st.read_index(spark, sink, some)
            assert {r.id for r in got.collect()} == {k for k in want if int(k.split("_")[0]) in some}
        plan = st.read_index(spark, sink, [12])._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [part" in plan or "PartitionFilters: [isnotnull(part" in plan

    grow(files[0])
    grow(files[1])
    check()
    assert st.compact_index(spark, sink) == 1
    check()
    assert len(st._folders(spark, sink, "batch")) == 0
    grow(files[2])
    check()
    assert st.compact_index(spark, sink) == 2 == st.compact_index(spark, sink)
    check()
    assert list(st._folders(spark, f"{sink}/_compacted", "upto")) == [2]
