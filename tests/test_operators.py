"""Edges the shared tables do not reach, and comparisons with brute force."""

import contextlib
import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.embedding import HashEmbedder
from tidemark.operators import access, audit, memory, metrics, ordering, ratelimit, retrieval, schedule, threats, transforms, validation, workflow
from tidemark.sources import files, html

T0 = dt.datetime(2024, 1, 1)
SEC = 1_000_000


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


# ------------------------------------------------------------------ ordering


def test_position_in_order_matches_sort(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.6 else f"k{i % 5}", rng.randrange(1000), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    out = ordering.position_in_order(df, ["k"], F.floor(F.col("v") / 100), ["v", "id"], "pos").collect()
    for key in {r[0] for r in rows}:
        want = [r[2] for r in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))]
        assert [r["id"] for r in sorted((r for r in out if r["k"] == key), key=lambda r: r["pos"])] == want


@pytest.mark.parametrize("n", [0, 1, 7, 40, 1000])
def test_newest(spark, n):
    rows = [(i, at(i * 7 % 301)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, t timestamp_ntz")
    got = {r["id"] for r in ordering.newest(df, ordering.micros(F.col("t")), "id", n).collect()}
    assert got == {r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)[:n]}


def test_first_n_above_the_native_limit(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    out = ordering.first_n(df, ["k"], [F.desc("v")], 1500)
    assert out.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("m")).orderBy("k").collect() == [(0, 1500, 2000), (1, 1500, 2001)]


# --------------------------------------------------------------------- audit


def test_filter_is_half_open_and_security_filter_closed(spark):
    df = spark.createDataFrame([(i, at(i), 10) for i in range(5)], "id int, timestamp timestamp_ntz, risk_score int")
    assert audit.audit_filter(df, start=at(1), end=at(3)).count() == 2
    assert audit.security_filter(df, start=at(1), end=at(3)).count() == 3


def _entries(spark, n=6):
    rows = [(1, i, at(i), "UserAction", f"a{i % 2}", "r", "act", "Success", "Low") for i in range(n)]
    return spark.createDataFrame(
        rows, "log_id int, id int, timestamp timestamp_ntz, event_type string, actor string, resource string, action string, outcome string, risk_level string"
    )


def test_chain_detects_change_and_loss_and_takes_an_anchor(spark):
    df = _entries(spark)
    stored = df.join(audit.build_chain(df).drop("log_id"), "id").cache()
    assert audit.verify_chain(stored).count() == 0
    changed = stored.withColumn("actor", F.when(F.col("id") == 2, "evil").otherwise(F.col("actor")))
    assert [(r["id"], r["reason"]) for r in audit.verify_chain(changed).collect()] == [(2, "chain_hash")]
    lost = stored.filter("id <> 3")
    assert [(r["id"], r["reason"]) for r in audit.verify_chain(lost).collect()] == [(4, "previous_hash")]
    kept = stored.filter("id >= 2")
    assert audit.verify_chain(kept).count() == 1
    anchor = stored.filter("id = 1").first()["chain_hash"]
    assert audit.verify_chain(kept, anchor=anchor).count() == 0


def test_performance_averages_memory_over_all_rows(spark):
    df = spark.createDataFrame([(100.0, 64, "Success"), (None, None, "Failure"), (50.0, None, "Success"), (None, 16, "Success")],
                               "execution_time_ms double, memory_usage_mb int, outcome string")
    r = audit.audit_performance(df).first()
    assert (r.avg_execution_time_ms, r.total_operations, r.avg_memory_usage_mb, r.error_rate) == (75.0, 2, 20.0, 0.25)
    empty = audit.audit_performance(df.limit(0)).first()
    assert (empty.avg_execution_time_ms, empty.error_rate) == (0.0, 0.0)


def test_empty_log_scores_100(spark):
    df = _entries(spark, 1).limit(0).withColumn("details", F.lit(None).cast("map<string,string>"))
    for name in ("chain_hash", "previous_hash", "session_id", "tool_name"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    assert audit.compliance_score(df).first().compliance_score == 100.0
    assert audit.compliance_violations(df).count() == 0


def test_export_formats(spark, tmp_path):
    df = _entries(spark).withColumn("chain_hash", F.lit("h"))
    files.export_audit(df, "YAML", str(tmp_path / "y"))
    back = files.load_yaml(spark, str(tmp_path / "y"), force="yaml")
    assert back.filter("error is not null").count() == 0
    with pytest.raises(ValueError):
        files.export_audit(df, "pdf", str(tmp_path / "p"))


# ------------------------------------------------------------------- threats


def test_brute_force_window_excludes_the_cutoff(spark):
    times = [0, 60, 120, 180, 300, 359]
    df = spark.createDataFrame([(i, "ip", at(t)) for i, t in enumerate(times)], "id int, source string, timestamp timestamp_ntz")
    # at t=300 the first attempt is exactly five minutes old and no longer counts
    got = {r["id"]: r["attempts"] for r in threats.sliding_count(df, out="attempts").collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 4, 4: 4, 5: 5}
    assert {r["id"] for r in threats.brute_force(df).collect()} == {5}


def test_sliding_count_of_a_hot_source(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else "cold", at(rng.randrange(4000))) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, source string, timestamp timestamp_ntz")
    got = {r["id"]: r["events"] for r in threats.sliding_count(df).collect()}
    for i, s, t in rows:
        assert got[i] == sum(1 for _, s2, t2 in rows if s2 == s and t - dt.timedelta(minutes=5) < t2 <= t)


def test_request_scan_samples(spark):
    rows = [(0, "/login", "username=admin' OR '1'='1"), (1, "/c", "comment=<script>alert('xss')</script>"), (2, "/ok", None),
            (3, "/x", "<script\n>a</script>"), (4, "/q", "' or '\n' = '"), (5, "/q", "a\r'or'='")]
    df = spark.createDataFrame(rows, "id int, uri string, body string")
    got = {r["id"]: r["threat_type"] for r in threats.scan_requests(df).collect()}
    assert got == {0: "sql_injection", 1: "xss_attack", 5: "sql_injection"}


def test_is_ip(spark):
    cases = {"1.2.3.4": True, "256.1.1.1": False, "01.2.3.4": False, "::1": True, "2001:db8::1": True, "1:2:3:4:5:6:7:8": True,
             "1:2:3": False, "::ffff:1.2.3.4": True, "a::b::c": False, "": False}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", threats.is_ip(F.col("v")).alias("ok"))
    assert {r["v"]: r["ok"] for r in df.collect()} == cases


def _naive_limits(times, cfg):
    accepted, until, out = [], 0, []
    for now in times:
        if now < until:
            out.append("blocked")
            continue
        inside = lambda span: sum(1 for t in accepted if now - t < span * SEC)
        for name, span, limit, block in (("minute_exceeded", cfg.minute, cfg.per_minute, cfg.minute_block),
                                         ("hour_exceeded", cfg.hour, cfg.per_hour, cfg.hour_block),
                                         ("burst_exceeded", cfg.burst_window, cfg.burst, cfg.burst_block)):
            if inside(span) >= limit:
                until = now + block * SEC
                out.append(name)
                break
        else:
            accepted.append(now)
            out.append("allowed")
    return out


def test_quiet_times_of_a_client_cut_its_fold(spark):
    """Small limits, busy and quiet times and a null client: cut histories give the verdicts of a plain fold."""
    rng, rows, n = random.Random(12), [], 0
    cfg = ratelimit.RateConfig(per_minute=3, per_hour=6, burst=2, minute=40, hour=90, burst_window=5, minute_block=60, hour_block=100, burst_block=20)
    for client in ("a", "b", "c", None):
        t = 0.0
        for _ in range(60):
            busy = rng.random() < 0.4
            for _ in range(rng.randint(1, 9) if busy else 1):
                t += rng.uniform(0, 12) if busy else rng.uniform(20, 160)
                rows.append((client, n, T0 + dt.timedelta(microseconds=round(t * 1e6))))
                n += 1
    df = spark.createDataFrame(rows, "client_id string, id int, timestamp timestamp_ntz")
    got = {r["id"]: r["verdict"] for r in ratelimit.rate_limit(df, cfg).collect()}
    for client in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == client), key=lambda r: (r[2], r[1]))
        assert [got[r[1]] for r in mine] == _naive_limits([round((r[2] - T0).total_seconds() * 1e6) for r in mine], cfg)
    cut = ratelimit.with_episode(df, "client_id", "timestamp", cfg.memory, 2)
    whole = ratelimit.with_episode(df, "client_id", "timestamp", cfg.memory)
    episodes = lambda d: d.select("client_id", "_episode").distinct().count()
    assert cut.count() == len(rows) and episodes(cut) > episodes(whole)


def test_rate_limit_defaults_against_a_plain_fold(spark):
    rng, rows, n = random.Random(3), [], 0
    for client, gap in (("burst", 0.2), ("minute", 0.55), ("hour", 3.4), ("idle", 4000)):
        t = 0.0
        for _ in range(1300 if client == "hour" else 300):
            t += gap if client == "minute" else rng.uniform(0, 2 * gap)
            rows.append((client, n, T0 + dt.timedelta(microseconds=round(t * 1e6))))
            n += 1
    df = spark.createDataFrame(rows, "client_id string, id int, timestamp timestamp_ntz")
    got = {r["id"]: r["verdict"] for r in ratelimit.rate_limit(df).collect()}
    seen = set()
    for client in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == client), key=lambda r: (r[2], r[1]))
        want = _naive_limits([round((r[2] - T0).total_seconds() * 1e6) for r in mine], ratelimit.RateConfig())
        assert [got[r[1]] for r in mine] == want
        seen |= set(want)
    assert seen == {"allowed", "blocked", "minute_exceeded", "hour_exceeded", "burst_exceeded"}


# -------------------------------------------------------------------- access


def test_policy_exact_prefix_star_tie_and_default(spark):
    none = "cast(array() as array<struct<field:string,op:string,value:string,values:array<string>>>) as conditions"
    rules = spark.createDataFrame(
        [("r1", "Allow", 5, ["tool:*"]), ("r2", "Deny", 5, ["tool:delete"]), ("r3", "Allow", 1, ["net*"]), ("r4", "Deny", 9, ["tool:rm**"])],
        "rule_id string, effect string, priority int, actions array<string>").selectExpr("*", none)
    asks = spark.createDataFrame([(1, "tool:read"), (2, "tool:delete"), (3, "network"), (4, "other"), (5, "tool:rmdir")], "id int, action string")
    asks = asks.withColumn("context", F.create_map().cast("map<string,string>"))
    got = {r["id"]: (r["allowed"], r["rule_id"]) for r in access.policy_decide(asks, rules).collect()}
    assert got == {1: (True, "r1"), 2: (True, "r1"), 3: (True, "r3"), 4: (False, None), 5: (False, "r4")}
    conflicts = {(r["rule_a"], r["rule_b"]) for r in access.policy_conflicts(rules).collect()}
    assert conflicts == {("r1", "r2")}


def test_role_inheritance_depth_and_cycle(spark):
    roles = spark.createDataFrame(
        [("a", ["p1"], ["b"]), ("b", ["p2"], ["c"]), ("c", ["p3"], ["d"]), ("d", ["p4"], ["a"]), ("x", [], ["ghost"])],
        "role string, permissions array<string>, inherits_from array<string>")
    users = spark.createDataFrame([("u", "a"), ("v", "x"), ("w", "nope")], "user_id string, role string")
    got = sorted(r["permission"] for r in access.effective_permissions(users, roles).collect())
    assert got == ["p1", "p2", "p3", "p4"]


# ------------------------------------------------------------------ workflow


def _steps(spark, rows):
    return spark.createDataFrame(rows, "workflow_id int, step_id string, depends_on array<string>, continue_on_error boolean")


def _exchanges(df):
    import re

    return len(re.findall(r"Exchange (?:hash|range|Single)", df._jdf.queryExecution().executedPlan().toString()))


def test_detectors_equal_plain_counts(spark):
    """Windows by a running sum against a plain count over all rows, ties and floods included; one shuffle of rows."""
    rng, minute = random.Random(11), 60_000_000
    at = [rng.choice([rng.randrange(0, 7_200), rng.randrange(3_000, 3_060), 3_600]) * 1_000_000 + rng.choice([0, 0, 1]) for _ in range(900)]
    rows = [(i, rng.choice(["a", "a", "b", None]), t, rng.choice(["Failure", "Success", None]), rng.choice([None, 1.5, 100.0])) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "id int, source string, t long, outcome string, bytes double").withColumn("timestamp", F.timestamp_micros("t"))

    def seen(keep, window):
        return {i: sum(1 for j, s2, u, o2, _ in rows if s2 == s and keep(o2) and t - window < u <= t) for i, s, t, o, _ in rows if keep(o)}

    failures, requests = seen(lambda o: o == "Failure", 5 * minute), seen(lambda o: True, minute)
    got = {r["id"]: r["attempts"] for r in threats.brute_force(df.filter("outcome = 'Failure'")).collect()}
    assert got == {i: n for i, n in failures.items() if n >= 5}
    got = {r["id"]: r["requests"] for r in threats.rate_abuse(df, limit=20).collect()}
    assert got == {i: n for i, n in requests.items() if n > 20}
    patterns = [threats.ThreatPattern("f", "failures", "High", 5 * minute, 5), threats.ThreatPattern("r", "requests", "Low", minute, 20),
                threats.ThreatPattern("r9", "requests", "Low", 9 * minute, 40), threats.ThreatPattern("b", "bytes", "High", minute, 900.0)]
    want = {}
    for i, s, t, o, size in rows:
        for p, hit, n in (("f", failures.get(i, 0) >= 5, failures.get(i)), ("r", requests[i] > 20, requests[i])):
            if hit:
                want.setdefault((p, s), []).append(float(n))
    for i, n in seen(lambda o: True, 9 * minute).items():
        if n > 40:
            want.setdefault(("r9", rows[i][1]), []).append(float(n))
    slots = {}
    for _, s, t, _, size in rows:
        if size is not None:
            slots[s, t // minute] = slots.get((s, t // minute), 0) + size
    for (s, _), total in slots.items():
        if total >= 900:
            want.setdefault(("b", s), []).append(total)
    found = threats.detect(df, patterns)
    assert {(r.pattern, r.source): (r.detections, r.peak) for r in found.collect()} == {k: (len(v), max(v)) for k, v in want.items()}
    assert {p for p, _ in want} == {"f", "r", "r9", "b"}
    assert _exchanges(threats.brute_force(df)) == 1


def test_little_of_a_history_is_context(spark):
    """A steady source: rows handed to two panes stay under a tenth."""
    from tidemark.operators.ordering import split_by_time

    steady = spark.range(20_000).select((F.col("id") * 1_000_000).alias("_at"))
    sliced = split_by_time(steady, F.col("_at"), threats.MINUTE, threats.PANE * threats.MINUTE)
    assert 0 < sliced.filter("_context").count() < 2_000


def test_segments_of_a_chain_are_checked_apart(spark, sf_dir):
    """From checkpoints the same verdicts as from the first entry; a period alone is checked without the rest."""
    import datetime as dt

    from tidemark.operators import audit
    from tidemark.plans.audit import _logged, _tampered

    chain, stored = audit.build_chain(_logged(spark, sf_dir)), _tampered(spark, sf_dir)
    hash_only = stored.withColumn("chain_hash", F.when(F.col("id") % 401 == 7, F.lit("0")).otherwise(F.col("chain_hash")))
    start, end = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)
    for df in (stored, hash_only):
        want = sorted(map(tuple, audit.verify_period(df, start, end).collect()))
        for every in (1, 3, 16, 10_000):
            marks = audit.chain_checkpoints(chain, every)
            assert sorted(map(tuple, audit.verify_period(df, start, end, checkpoints=marks, every=every).collect())) == want
        assert any(r[3] for r in want) and any(not r[5] for r in want)
    alone = audit.verify_period(stored, start, end, checkpoints=audit.chain_checkpoints(chain, 3), every=3, whole=False).collect()
    logs = {r[0]: r for r in map(tuple, audit.verify_period(stored, start, end).collect()) if r[1]}
    assert {r.log_id: r.total_entries for r in alone} == {k: r[1] for k, r in logs.items()}
    assert all(r.corrupted_entries <= logs[r.log_id][3] for r in alone)


def test_dag_levels_chain_diamond_cycle_missing(spark):
    steps = _steps(spark, [(1, "a", [], None), (1, "b", ["a"], None), (1, "c", ["a"], None), (1, "d", ["b", "c"], None),
                           (2, "a", ["b"], None), (2, "b", ["a"], None), (2, "c", ["a"], None), (2, "z", [], None), (3, "a", ["nope"], None)])
    got = {(r[0], r[1]): r[2] for r in workflow.dag_levels(steps).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 1, (1, "d"): 2, (2, "a"): None, (2, "b"): None, (2, "c"): None, (2, "z"): 0, (3, "a"): None}


def test_skip_propagation_alternates_along_failures(spark):
    chain = [(1, f"s{i}", [f"s{i - 1}"] if i else [], False) for i in range(5)]
    steps = _steps(spark, [*chain, (1, "go", ["s0"], True), (1, "after", ["s1"], False)])
    results = spark.createDataFrame([(1, f"s{i}", "Failed") for i in range(5)] + [(1, "go", "Success"), (1, "after", "Success")],
                                    "workflow_id int, step_id string, status string")
    got = {r[1]: r[2] for r in workflow.propagate_status(steps, results).collect()}
    # a skipped step does not block the next one, which then fails itself
    assert got == {"s0": "Failed", "s1": "Skipped", "s2": "Failed", "s3": "Skipped", "s4": "Failed", "go": "Success", "after": "Success"}


def test_skip_propagation_keeps_steps_without_a_result(spark):
    steps = spark.createDataFrame([("w", "a", [], None), ("w", "b", ["a"], None), ("w", "c", [], None), ("w", "d", ["c"], None)],
                                  "workflow_id string, step_id string, depends_on array<string>, continue_on_error boolean")
    for status, after in (("Failed", "Skipped"), ("Success", None)):
        results = spark.createDataFrame([("w", "a", status)], "workflow_id string, step_id string, status string")
        got = {r["step_id"]: r["status"] for r in workflow.propagate_status(steps, results).collect()}
        assert got == {"a": status, "b": after, "c": None, "d": None}



def test_safety_modes(spark):
    rows = [(1, "a", "Command", "rm -rf /", None, None, 5), (2, "a", "DeleteFile", None, "/etc/passwd", None, 5),
            (3, "a", "Http", None, None, "http://x.y", 5), (4, "a", "Command", "ls", None, None, None)]
    df = spark.createDataFrame(rows, "workflow_id int, step_id string, step_type string, command string, path string, url string, timeout_seconds int")
    got = {m: {r["workflow_id"]: (r["risk_score"], r["is_safe"]) for r in workflow.safety_risk(df, m).collect()} for m in ("permissive", "standard", "strict")}
    assert got["standard"] == {1: (130, False), 2: (50, False), 3: (15, True), 4: (10, True)}
    assert got["permissive"][2] == (50, True)
    assert got["strict"][4] == (15, True)


# ----------------------------------------------------------------- retrieval


def _windows(text_, size, overlap):
    out, start = [], 0
    while True:
        end = min(start + size, len(text_))
        out.append((text_[start:end], start, end))
        if end == len(text_):
            return out
        start = end - overlap


@pytest.mark.parametrize("size,overlap", [(5, 0), (5, 2), (7, 6)])
def test_chunks_against_a_loop(spark, size, overlap):
    texts = ["", "abc", "abcde", "abcdefghij", "äöü€𝄞" * 4, "x" * 33]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in text.chunk_text(df, size, overlap).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append((r["content"], r["start_index"], r["end_index"]))
    assert got == {i: _windows(t, size, overlap) for i, t in enumerate(texts)}


def test_chunk_arguments(spark):
    with pytest.raises(ValueError):
        text.chunk_text(spark.createDataFrame([(1, "a")], "doc_id int, text string"), 10, 10)


def test_cosine_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 0.0]), (2, [1.0], [1.0, 2.0]), (3, [1.0, 1.0], [2.0, 2.0])], "id int, a array<float>, b array<float>")
    got = {r[0]: r[1] for r in df.select("id", F.round(retrieval.cosine(F.col("a"), F.col("b")), 6)).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 1.0}


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("threshold", [None, 0.3])
def test_vector_search_blocks_and_brute_force(spark, metric, threshold):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(200, 6)).round(2)
    vectors[17] = vectors[3]  # a tie
    vectors[20] = 0.0
    store = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, [1.0, 2.0])], "id int, embedding array<double>")
    queries = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(9)], "query_id int, embedding array<double>")
    limit = threshold if metric == "cosine" or threshold is None else 6.0
    whole = retrieval.vector_search(queries, store, 5, limit, metric=metric).orderBy("query_id", "rank").collect()
    blocked = retrieval.vector_search(queries, store, 5, limit, metric=metric, query_rows=2, store_rows=30).orderBy("query_id", "rank").collect()
    assert whole == blocked
    for q in range(9):
        scored = []
        for i, v in enumerate(vectors):
            if metric == "l2":
                d = round(float(((v - vectors[q]) ** 2).sum()), 6)
                if limit is None or d <= limit:
                    scored.append((d, i))
            else:
                n = math.sqrt((v @ v) * (vectors[q] @ vectors[q]))
                s = round(float(v @ vectors[q]) / n, 6) if n else 0.0
                if limit is None or s >= limit:
                    scored.append((-s, i))
        if metric == "cosine" and limit is None:
            scored.append((0.0, 900))
        want = [i for _, i in sorted(scored)[:5]]
        assert [r["id"] for r in whole if r["query_id"] == q] == want


def test_context_pack_may_exceed_by_one_separator(spark):
    rows = [(1, 1, "aaaa"), (1, 2, "bbbb"), (1, 3, "cccc"), (1, 4, "d"), (2, 1, "too long"), (2, 2, "x"), (3, 1, ""), (3, 2, "ok")]
    df = spark.createDataFrame(rows, "query_id int, rank int, content string")
    got = {r["query_id"]: r["context"] for r in retrieval.pack_context(df, 8).collect()}
    assert got == {1: "aaaa\n\nbbbb", 2: "too long", 3: "ok"}


def test_hash_embedding_tail_uses_byte_length(spark):
    v = HashEmbedder(4).embed_batch(["é"])[0]
    f = np.float32
    assert v[0] == np.mod(f(233), f(1))
    assert v[2] == np.mod(f(2 * 3) * f(0.001), f(1))


# -------------------------------------------------------------------- metrics


@pytest.mark.parametrize("signs", [(1,), (1, -1)])
def test_sparse_search_equals_brute_force(spark, signs):
    """A term that every row has with small values, ties, few matches, and values of both signs."""
    rng = random.Random(len(signs))
    store, queries = {}, {}
    for i in range(400):
        store[i] = {0: rng.choice([1.0, 1.0, 2.0]) * rng.choice(signs)} | {rng.randrange(1, 60): rng.choice([1.0, 3.0, 9.5]) * rng.choice(signs) for _ in range(4)}
    for j in range(12):
        queries[j] = {t: rng.choice([0.5, 1.0, 4.0]) * rng.choice(signs) for t in rng.sample(range(0, 64), rng.choice([1, 3, 6]))}
    queries[12], queries[13] = {0: 2.0}, {99: 1.0}
    long = lambda rows, key: spark.createDataFrame([(i, t, v) for i, d in rows.items() for t, v in d.items()], f"{key} int, index int, value double")
    got = {}
    asked, rows = long(queries, "query_id"), long(store, "id")
    found = retrieval.sparse_search(asked, rows, 5, most_products=0).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, retrieval.sparse_search(asked, rows, 5).collect()))
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.id, round(r.score, 9)))
    for j, terms in queries.items():
        scored = [(sum(v * d[t] for t, v in terms.items() if t in d), i) for i, d in store.items() if d.keys() & terms.keys()]
        best = sorted(scored, key=lambda x: (-x[0], x[1]))[:5]
        assert sorted(got.get(j, [])) == [(n, i, round(x, 9)) for n, (x, i) in enumerate(best, 1)]


def test_a_common_word_does_not_bring_every_row(spark, monkeypatch):
    """Rare words decide: the pairs that are scored stay far below queries x rows."""
    store = spark.range(20_000).select("id", F.explode(F.array(
        F.struct(F.lit(-1).cast("long").alias("index"), (1.0 + (F.col("id") % 5) / 100).alias("value")),
        F.struct((F.col("id") % 1_000).alias("index"), (20.0 + F.col("id") % 7).alias("value")))).alias("t")).select("id", "t.*")
    queries = spark.range(30).select(F.col("id").alias("query_id"), F.explode(F.array(
        F.struct(F.lit(-1).cast("long").alias("index"), F.lit(1.0).alias("value")), F.struct((F.col("id") * 3).alias("index"), F.lit(1.0).alias("value")))).alias("t")).select("query_id", "t.*")
    scored, whole = [], retrieval._sparse_scores

    def counting(pairs, q, s):
        scored.append(pairs.count())
        return whole(pairs, q, s)

    monkeypatch.setattr(retrieval, "_sparse_scores", counting)
    assert retrieval.sparse_search(queries, store, 5, most_products=0).count() == 150
    assert sum(scored) < 3_000  # of 600,000


def _ranked_as_sorted(df, rows):
    found = {r["operation"]: r for r in metrics.benchmark_stats(df).collect()}
    groups = {}
    for k, x in rows:
        if x is not None:
            groups.setdefault(k, []).append(x)
    assert found.keys() == groups.keys()
    for key, v in groups.items():
        r, v, n = found[key], sorted(v), len(v)
        assert r["iterations"] == n
        assert r["median"] == (v[n // 2] if n % 2 else (v[n // 2 - 1] + v[n // 2]) / 2)
        assert (r["p95"], r["p99"], r["min"], r["max"]) == (v[int(n * 0.95)], v[int(n * 0.99)], v[0], v[-1])
        assert (r["stdev"] is None) == (n == 1)


def test_order_statistics_of_a_skewed_group(spark):
    rng = random.Random(5)
    rows = [("hot", float(rng.choice([1, 1, 1, 2, 50, 1000, rng.random() * 1e6]))) for _ in range(999)]
    rows += [("one", 7.0), ("two", 1.0), ("two", 2.0), (None, 3.0), (None, 4.0), ("empty", None), ("same", 5.0), ("same", 5.0), ("same", 5.0)]
    _ranked_as_sorted(spark.createDataFrame(rows, "operation string, duration_ms double"), rows)
    assert metrics.benchmark_stats(spark.createDataFrame([], "operation string, duration_ms double")).count() == 0


def test_an_outlier_does_not_fill_a_range(spark):
    """200,000 values and one of 1e12: what is put in order for a rank stays below a hundredth of them."""
    values = spark.range(200_000).select(F.lit("op").alias("operation"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("duration_ms"))
    df = values.unionByName(spark.createDataFrame([("op", 1e12)], "operation string, duration_ms double"))
    rows = [("op", r[1]) for r in df.collect()]
    _ranked_as_sorted(df, rows)
    sketch = [r[0] for r in df.select(F.percentile_approx("duration_ms", [0.947, 0.953], 10_000)).collect()][0]
    assert sum(sketch[0] <= v <= sketch[1] for _, v in rows) < 2_000


# ---------------------------------------------------------------------- other


def test_zero_capacity_conversation_and_ttl_bound(spark):
    c = spark.createDataFrame([(1, i, "user", "x") for i in range(3)], "conv_id int, turn int, role string, text string")
    assert memory.last_messages(c, 0).count() == 0
    assert memory.last_messages(c, 2).count() == 2
    e = spark.createDataFrame([("a", at(5)), ("b", at(4)), ("c", None)], "key string, expires_at timestamp_ntz")
    assert {r["key"] for r in memory.not_expired(e, at(5)).collect()} == {"a", "c"}


def test_cron_forms(spark):
    cases = {"*/15 * * * *": None, "1,2-3 * * * *": "invalid minute", "5-1 * * * *": "invalid minute", "* * 0 * *": "invalid day_of_month",
             "@hourly": None, "*/0 * * * *": "invalid minute", "a * * * *": "invalid minute", "* * * * 8": "invalid day_of_week",
             "": "expected 5 or 6 fields", "0 0 0 1 1 7": None, "10/20 * * * *": None}
    df = spark.createDataFrame([(k,) for k in cases], "expression string")
    parsed = {r["expression"]: r for r in schedule.parse_schedules(df).collect()}
    assert {k: r["error"] for k, r in parsed.items()} == cases
    assert parsed["10/20 * * * *"]["minute"] == [10, 30, 50]
    assert parsed["0 0 0 1 1 7"]["day_of_week"] == [0]
    fired = schedule.expand_schedules(df.filter("expression = '@hourly'"), at(3600), at(7200))
    assert [r["fire_at"] for r in fired.collect()] == [at(3600)]


def test_substitute_guards(spark):
    df = spark.createDataFrame([("{a} {b} {c..d} {x} {a}", {"a": "1", "b": "x;y", "c..d": "2"})], "t string, v map<string,string>")
    assert df.select(transforms.substitute(F.col("t"), F.col("v"))).first()[0] == "1 {b} {c..d} {x} 1"


def test_infer_survives_a_failing_model(spark):
    def broken(prompts):
        raise RuntimeError("down")

    out = transforms.infer(spark.createDataFrame([("a",), ("b",)], "prompt string"), broken).select("response.*").collect()
    assert [r["finish_reason"] for r in out] == ["error", "error"]


def test_validation_order_and_boundaries(spark):
    rule = validation.Rule(required=True, min_length=2, max_length=4, pattern=r"^[a-z]+$")
    cases = {None: "required", "a": "too_short", "abcde": "too_long", "a<b": "prohibited", "AB": "format", "ab\n": "format", "abcd": None, "é": "format"}
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["v_error"] for r in validation.validate(df, {"v": rule}).collect()}
    assert got == cases


def test_paths_and_commands(spark):
    paths = {"/etc": "system_directory", "/etcetera/x": "ok", "/a/.git": "ok", "/a/.bashrc": "hidden", "a/NUL": "reserved_name", "/x/./y": "ok"}
    df = spark.createDataFrame([(k,) for k in paths], "path string")
    assert {r["path"]: r["path_class"] for r in validation.classify_paths(df).collect()} == paths
    commands = [("echo", ["successfully"], "ok"), ("echo", ["su"], "denied_word"), ("git", ["PUSH"], "remote_git"), ("/bin/Cat", ["x"], "ok"),
                ("curl", ["https://10.0.0.1/"], "private_host"), (";", [], "denied_command"), ("vim", [], "not_allowed")]
    df = spark.createDataFrame(commands, "command string, args array<string>, want string")
    assert validation.classify_commands(df).filter("command_class <> want").count() == 0


def test_the_first_failing_argument_counts(spark):
    """One search in joined arguments against a look at every argument; nulls and the joint itself among them."""
    rng = random.Random(6)
    parts = ["x", "sub", "su", "rm", "rm -rf", "/etc/passwd", "/etc/hosts", "a;b", "..", "~", "", None, "é", "su\u0001x", "\u0001", "a\u0001;", "$(x)", "/dev/null su", "-", "C:\\windows\\x"]
    plain = {}
    rows = [(i, "echo", [rng.choice(parts) for _ in range(rng.randint(0, 6))]) for i in range(600)] + [(600, "echo", None)]
    alone = spark.createDataFrame([(j, "echo", [p]) for j, p in enumerate(parts)], "id int, command string, args array<string>")
    for r in validation.classify_commands(alone).collect():
        plain[parts[r.id]] = r.command_class
    assert {"ok", "metacharacter", "denied_word", "system_path", "traversal"} <= set(plain.values())
    got = {r.id: r.command_class for r in validation.classify_commands(spark.createDataFrame(rows, "id int, command string, args array<string>")).collect()}
    for i, _, args in rows:
        assert got[i] == next((plain[x] for x in args or () if plain[x] != "ok"), "ok"), args


def test_report_parts_equal_their_own_operators(spark, sf_dir):
    """Three scans give what every part gives alone, for an empty period too."""
    from tidemark.operators import audit
    from tidemark.plans.audit import END, START, _detailed

    df = _detailed(spark, sf_dir)
    for start, end in ((START, END), (dt.datetime(1990, 1, 1), dt.datetime(1990, 1, 2))):
        period, parts = audit.audit_filter(df, start=start, end=end), audit.audit_report(df, start, end)
        alone = {"counts": audit.audit_counts(period), "top_actors": audit.top_n(period, "actor"), "top_resources": audit.top_n(period, "resource"),
                 "highlights": audit.security_highlights(period), "performance": audit.audit_performance(period),
                 "violations": audit.compliance_violations(period), "score": audit.compliance_score(period)}
        for name, want in alone.items():
            assert sorted(map(str, parts[name].collect())) == sorted(map(str, want.collect())), name


def test_malformed_html(spark):
    page = ('<html lang=en><head><title> A &amp; B </title><script>x="<p>"</script></head><body><h1>One<h2>Two</h2>'
            "<p title='a>b'>Text<!-- <p>no</p> --><a href=/x>go</a><a href='/y'></a><a>none</a><style>p{}</style> end")
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    s = html.html_structure(df).first()
    assert (s["title"], s["paragraphs"], s["links"], s["h1"], s["h2"]) == ("A & B", 1, 3, 1, 1)
    assert [(r["level"], r["text"]) for r in html.html_headings(df).collect()] == [(1, "One"), (2, "Two")]
    assert [(r["href"], r["text"]) for r in html.html_links(df).collect()] == [("/x", "go"), ("/y", "(no text)")]
    assert html.html_text(df).first()["text"].split() == ["One", "Two", "Text", "go", "none", "end"]
    assert {(r["name"], r["content"]) for r in html.html_metadata(df).collect()} == {("title", "A & B"), ("lang", "en")}
    with pytest.raises(ValueError):
        html.html_analyze(df, "images")


def test_yaml_errors_and_json_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("a: [1, 2]\n")
    (tmp_path / "b.yaml").write_text("a: [1, 2\n")
    (tmp_path / "c.json").write_text('{"k": 1}')
    rows = files.load_yaml(spark, str(tmp_path)).select("format", F.to_json("payload").alias("j"), F.col("error").isNotNull().alias("bad")).collect()
    assert sorted((r["format"], r["j"], r["bad"]) for r in rows if r["j"]) == [("json", '{"k":1}', False), ("yaml", '{"a":[1,2]}', False)]
    assert sum(r["bad"] for r in rows) == 1


def test_file_inventory(spark, tmp_path):
    """Folders, empty ones too, hidden names, depth; many folders are dealt out to tasks."""
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "empty").mkdir()
    (tmp_path / ".git" / "in").mkdir(parents=True)
    for name in ("x.txt", "d/y.csv", "d/e/z.csv", ".env", ".git/in/cfg", "d/.keep"):
        (tmp_path / name).write_text("abc")
    listed = lambda **options: [(r["name"], r["path"], r["depth"], r["is_dir"], r["size"]) for r in files.file_inventory(spark, str(tmp_path), **options).collect()]
    seen = [("d", "d", 0, True, None), ("e", "d/e", 1, True, None), ("empty", "empty", 0, True, None),
            ("x.txt", "x.txt", 0, False, 3), ("y.csv", "d/y.csv", 1, False, 3), ("z.csv", "d/e/z.csv", 2, False, 3)]
    assert listed() == seen
    assert listed(max_depth=1) == seen[:5] and listed(recursive=False) == [seen[0], seen[2], seen[3]] == listed(max_depth=0)
    hidden = [(".env", ".env", 0, False, 3), (".git", ".git", 0, True, None), (".keep", "d/.keep", 1, False, 3), ("cfg", ".git/in/cfg", 2, False, 3), ("in", ".git/in", 1, True, None)]
    assert listed(include_hidden=True) == sorted([*seen, *hidden])
    for i in range(90):
        (tmp_path / "many" / f"f{i}" / "sub").mkdir(parents=True)
        (tmp_path / "many" / f"f{i}" / "sub" / "leaf").write_text("x" * i)
    found = files.file_inventory(spark, str(tmp_path / "many"))
    assert found.filter("NOT is_dir").count() == 90 and found.filter("is_dir").count() == 180 and found.agg(F.sum("size")).first()[0] == 4005
    assert spark.read.format("tidemark_folder").load(str(tmp_path / "many")).rdd.getNumPartitions() > 60
    assert all(abs(r["modified"].timestamp() - (tmp_path / "x.txt").stat().st_mtime) < 1 for r in files.file_inventory(spark, str(tmp_path)).filter("name = 'x.txt'").collect())
    with pytest.raises(Exception, match="no folder"):
        files.file_inventory(spark, str(tmp_path / "x.txt")).collect()


def test_html_analysis_is_decoded(spark):
    page = """<html lang="fr"><head><title>A &amp; B</title><meta name=d content="x &lt; y"><meta charset=utf-8></head>
        <body><h1>Caf&eacute; &amp; <b>bar</b></h1><h2>&nbsp;</h2><a href="/?a=1&amp;b=2">go &gt;</a><a href='#'> </a><a>no</a></body></html>"""
    row = html.html_analyze(spark.createDataFrame([(1, page), (2, None)], "page_id int, html string"), "all").orderBy("page_id").collect()[0]
    assert [tuple(h) for h in row.headings] == [(1, "Café & bar")]
    assert [tuple(x) for x in row.link_list] == [("/?a=1&b=2", "go >"), ("#", "(no text)")]
    assert [tuple(m) for m in row.metas] == [("d", "x < y"), ("title", "A & B"), ("lang", "fr")]
    assert (row.title, row.lang) == ("A & B", "fr")


def plain_sentence_chunks(text, size):
    """The greedy rule word for word."""
    chunks, at, open_ = [], 0, ""
    for s in (x.strip() for x in text.split(".")):
        if not s:
            continue
        if open_ and len(open_.encode()) + len(s.encode()) + 2 > size:
            chunks.append((open_, at))
            at, open_ = at + len(open_.encode()), s
        else:
            open_ = f"{open_}. {s}" if open_ else s
    return chunks + [(open_, at)] if open_ else chunks


def test_sentence_chunks_of_a_long_text(spark):
    """Same chunks as the plain rule; 32,000 sentences take seconds at most."""
    import time

    from tidemark.functions import text as tx

    rng = random.Random(8)
    texts = ["", "...", "one", "a. b.c . é é. " * 9] + [". ".join("x" * rng.randrange(0, 40) for _ in range(rng.randrange(0, 60))) for _ in range(30)]
    long = ". ".join(f"sentence number {i} of many" for i in range(32_000))
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id int, text string")
    for size in (1, 30, 100):
        got = {}
        for r in tx.chunk_sentences(df, size).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r.doc_id, []).append((r.content, r.start_index))
        assert got == {i: c for i, t in enumerate(texts) if (c := plain_sentence_chunks(t, size))}
    one = spark.createDataFrame([(1, long)], "doc_id int, text string")
    started = time.time()
    got = [(r.content, r.start_index) for r in tx.chunk_sentences(one, 1000).orderBy("chunk_index").collect()]
    assert time.time() - started < 8 and got == plain_sentence_chunks(long, 1000)


def test_vector_blocks_are_bounded_in_bytes(spark, monkeypatch):
    """Long vectors make smaller blocks, with the same rows; stored vectors of other lengths score as before."""
    rng = random.Random(3)
    vec = lambda n: [rng.random() for _ in range(n)]
    store = spark.createDataFrame([(i, vec(48 if i % 9 else 7)) for i in range(300)], "id int, embedding array<double>")
    asked = spark.createDataFrame([(i, vec(48)) for i in range(20)], "query_id int, embedding array<double>")
    for metric in ("cosine", "l2"):
        whole = sorted(map(tuple, retrieval.vector_search(asked, store, 6, metric=metric).collect()))
        monkeypatch.setattr(retrieval, "BLOCK_BYTES", 8 * 48 * 13)
        cut = sorted(map(tuple, retrieval.vector_search(asked, store, 6, metric=metric).collect()))
        monkeypatch.undo()
        assert whole == cut and len(whole) == 120


def test_csv_keeps_line_ends_in_quotes_and_all_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,"say ""hi"", you"\n3,4,5,"6,7"\n8\n')
    rows = files.load_csv(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["a", "b", "Column_3", "Column_4"]
    assert sorted(map(tuple, rows.collect())) == [
        ("1", "x\ny", None, None), ("2", 'say "hi", you', None, None), ("3", "4", "5", "6,7"), ("8", None, None, None)]
    (tmp_path / "b.csv").write_text("1;2;3\n4\n")
    assert files.load_csv(spark, str(tmp_path / "b.csv"), ";", False).columns == ["Column_1", "Column_2", "Column_3"]


def test_csv_profile_of_quoted_line_ends(spark):
    df = spark.createDataFrame([(1, 'a,b\r\n1,"x\ny"\n\n2,"q""q"\n'), (2, 'a,b\n1,"open\n2,3'), (3, None), (4, 'a\n"' + '""' * 100_000 + '"')], "id int, content string")
    got = {r.id: r for r in files.csv_profile(df).collect()}
    assert got[1].records == [["1", "x\ny"], ["2", 'q"q']] and got[1].valid
    assert got[2].row_count == 2 and got[4].records == [['"' * 100_000]]


def test_a_null_text_has_no_chunks(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "abc")], "doc_id int, text string")
    assert [(r.doc_id, r.content) for r in text.chunk_text(df, 10, 2).orderBy("doc_id").collect()] == [(2, ""), (3, "abc")]


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_a_null_key_is_one_log(spark, kind):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        big = 2**53 + 1
        df = _entries(spark, 40).withColumn("log_id", F.when(F.col("id") % 2 == 0, F.lit(big)).cast(kind))
        rows = audit.build_chain(df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r.seq == 0 for r in rows) == 2
    assert {r.log_id for r in rows} == {None, big if kind == "bigint" else str(big)}


def test_upsert_keeps_one_row_of_a_key(spark):
    store = spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (1, "b"), (3, None), (3, "c")], "id int, v string")
    assert sorted(map(tuple, retrieval.upsert(store, new).collect())) == [(1, "b"), (2, "old"), (3, "c")]


def test_threshold_is_held_against_the_raw_score(spark):
    c = 0.6999997
    store = spark.createDataFrame([(1, [c, math.sqrt(1 - c * c)], "x"), (2, [0.8, 0.6], "y")], "id int, embedding array<double>, text string")
    query = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    assert [r.id for r in retrieval.vector_search(query, store, 5, 0.7).collect()] == [2]
    assert [r.id for r in retrieval.vector_search(query, store, 5, where_document={"$contains": "x"}).collect()] == [1]
    assert [r.id for r in retrieval.delete(store, where_document={"$contains": "x"}).collect()] == [2]


def test_every_log_has_its_own_anchor(spark):
    df = _entries(spark).union(_entries(spark).withColumn("log_id", F.lit(2)).withColumn("id", F.col("id") + 100)).union(
        _entries(spark).withColumn("log_id", F.lit(None)).withColumn("id", F.col("id") + 200))
    stored = df.join(audit.build_chain(df).drop("log_id"), "id").cache()
    assert audit.verify_chain(stored, block=2).count() == 0
    kept = stored.filter("seq >= 2")
    anchors = stored.filter("seq = 1").select("log_id", F.col("chain_hash").alias("anchor_hash"))
    assert audit.verify_chain(kept, anchor=anchors, block=3).count() == 0
    assert audit.verify_chain(kept, block=3).count() == 3


def test_html_patterns_do_not_overflow(spark):
    tag = "<a " + " ".join(f'x{i}="v"' for i in range(200_000)) + ' href="/y">t</a>'
    unbalanced = '<img alt="x>' + '<a href="/a">b</a>' * 3000
    df = spark.createDataFrame([(1, tag), (2, unbalanced)], "page_id int, html string")
    links = html.html_links(df).groupBy("page_id").count().collect()
    assert {r.page_id: r["count"] for r in links}[1] == 1
    for mode in ("text", "structure", "links", "metadata", "all"):
        assert html.html_analyze(df, mode).count() >= 0
        html.html_analyze(df, mode).write.format("noop").mode("overwrite").save()


def test_a_chain_goes_on_where_it_stopped(spark):
    df = _entries(spark, 9).union(_entries(spark, 4).withColumn("log_id", F.lit(None)).withColumn("id", F.col("id") + 50))
    whole = {r.id: (r.seq, r.previous_hash, r.chain_hash) for r in audit.build_chain(df).collect()}
    done = None
    for part in (df.filter("id < 3"), df.filter("id BETWEEN 3 AND 51"), df.filter("id > 51")):
        tails = None if done is None else done.groupBy("log_id").agg(F.max("seq").alias("seq"), F.max_by("chain_hash", "seq").alias("chain_hash"))
        new = audit.build_chain(part, tails=tails)
        done = spark.createDataFrame((done.collect() if done else []) + new.collect(), new.schema)
    assert {r.id: (r.seq, r.previous_hash, r.chain_hash) for r in done.collect()} == whole


def test_the_digest_of_an_empty_log(spark):
    logs = spark.createDataFrame([(1,), (7,), (None,)], "log_id int")
    got = {r.log_id: r.digest for r in audit.log_digest(_entries(spark), logs=logs).collect()}
    assert got[7] == got[None] == "genesis" and len(got[1]) == 64


def test_most_frequent_actions(spark):
    df = _entries(spark, 6).withColumn("action", F.concat(F.lit("a"), F.col("id") % 4))
    assert [(a.action, a.events) for a in audit.audit_summary(df).first().top_actions] == [("a0", 2), ("a1", 2), ("a2", 1), ("a3", 1)]
    empty = audit.audit_range(df.limit(0)).first()
    assert empty.total_events == 0 and empty.top_actions == []


def test_a_fold_hands_on_one_batch_for_each_it_gets(spark, monkeypatch):
    """Many short logs in one batch are not many small batches."""
    import pyarrow as pa

    df, held = _entries(spark), []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: held.append(run) or self.select("log_id", "id"))
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, run, schema: self.select("log_id", "id"))
    with contextlib.suppress(Exception):  # the stand-in lacks the new columns
        audit.build_chain(df, order=("id",))
    logs = [f"log {i // 2}" if i > 1 else None for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(logs), pa.array(range(2000)), pa.array([f"c{i}" for i in range(2000)])], ["log_id", "id", "content"])
    out = list(held[0](iter([batch, batch.slice(1999)])))
    assert [b.num_rows for b in out] == [2000, 1]
    assert out[0].column(out[0].schema.get_field_index("seq")).to_pylist() == [0, 1] * 1000
    last = {n: out[1].column(n)[0].as_py() for n in out[1].schema.names}
    assert last["seq"] == 2 and last["previous_hash"] == out[0].column(out[0].schema.names.index("chain_hash"))[1999].as_py()


def test_segments_of_a_null_log(spark):
    df = _entries(spark, 30).withColumn("log_id", F.when(F.col("id") % 2 == 0, F.lit(7)))
    chain = audit.build_chain(df)
    stored = df.join(chain.drop("log_id"), "id").withColumn("action", F.when(F.col("id") == 9, "x").otherwise(F.col("action"))).cache()
    period = dt.datetime(2000, 1, 1), dt.datetime(2100, 1, 1)
    want = {r.log_id: tuple(r) for r in audit.verify_period(stored, *period).collect()}
    got = {r.log_id: tuple(r) for r in audit.verify_period(stored, *period, checkpoints=audit.chain_checkpoints(chain, 3), every=3).collect()}
    assert got == want and want[7][4] and not want[None][4]
    assert want[None][1:4] == (15, 4, 11)
