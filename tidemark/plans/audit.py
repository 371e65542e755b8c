"""Audit queries over the audit and security views of ``events``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.fixed_values import TEST_TOKENS
from tidemark.functions import security as sec
from tidemark.operators import audit as op
from tidemark.operators.ordering import moment
from tidemark.plans.views import AUDIT_SQL, SECURITY_SQL, SQL_STAMP, audit_view, security_view, stamp
from tidemark.session import table

START, END = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20)
NOW = dt.datetime(2024, 1, 25, 12, 0, 0)
AUDIT = f"WITH audit AS ({AUDIT_SQL}) "
SECURITY = f"WITH sec AS ({SECURITY_SQL}) "
PERIOD = "timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-20'"
CLOSED = "timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"

_RISK_SQL = """CASE event_type
    WHEN 'authentication' THEN CASE WHEN flag THEN 10 ELSE 40 END
    WHEN 'authorization' THEN CASE WHEN flag THEN 5 ELSE 35 END
    WHEN 'data_access' THEN CASE grade WHEN 'Public' THEN 5 WHEN 'Internal' THEN 15
        WHEN 'Confidential' THEN 30 WHEN 'Restricted' THEN 50 ELSE 75 END
    WHEN 'threat_detected' THEN CASE grade WHEN 'Low' THEN 30 WHEN 'Medium' THEN 50
        WHEN 'High' THEN 75 ELSE 95 END
    ELSE CASE grade WHEN 'Minor' THEN 20 WHEN 'Major' THEN 60 ELSE 90 END END"""
_OUTCOME_SQL = """CASE event_type
    WHEN 'authentication' THEN CASE WHEN flag THEN 'Success' ELSE 'Failure' END
    WHEN 'authorization' THEN CASE WHEN flag THEN 'Success' ELSE 'Warning' END
    WHEN 'data_access' THEN 'Information' WHEN 'threat_detected' THEN 'Warning' ELSE 'Failure' END"""


def _detailed(spark, sf_dir):
    """Audit view with the detail keys the compliance rules look at."""
    df = audit_view(spark, sf_dir)
    i = F.col("id")
    before = F.when(i % 2 == 0, F.col("timestamp")).otherwise(F.col("timestamp") - F.expr("INTERVAL 5 SECONDS"))
    keyed = {
        "failed_attempts": F.col("details")["k"],
        "supervisor_approval": F.when(i % 4 == 0, "yes"),
        "admin_approval": F.when(i % 6 == 0, "yes"),
        "geo_location": F.when(i % 50 == 0, "tor exit").when(i % 50 == 1, "office"),
        "policy_violation": F.when(i % 8 == 0, "p1"),
        "previous_action_timestamp": F.when(i % 10 < 2, stamp_of(before)),
    }
    pairs = [F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in keyed.items()]
    entries = F.filter(F.array(*pairs), lambda e: e["v"].isNotNull())
    return (
        df.withColumn("details", F.map_from_entries(entries))
        .withColumn("action", F.when(i % 40 == 0, "admin_login").otherwise(F.col("action")))
        .withColumn("chain_hash", F.when(i % 300 == 0, "").otherwise("h"))
        .withColumn("previous_hash", F.when(i % 200 == 1, None).otherwise("h"))
    )


def stamp_of(col):
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


_WHERE_PERIOD = f" WHERE {PERIOD}"


def _detailed_sql(where=""):
    return AUDIT + f""", d AS (SELECT * REPLACE (CASE WHEN id % 40 = 0 THEN 'admin_login' ELSE action END AS action),
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS attempts,
        CASE WHEN id % 300 = 0 THEN '' ELSE 'h' END AS chain_hash,
        CASE WHEN id % 200 = 1 THEN NULL ELSE 'h' END AS previous_hash FROM audit{where}),
    hits AS (
    SELECT 'excessive_failed_attempts' AS rule, 'High' AS severity, timestamp FROM d WHERE outcome = 'Failure' AND attempts > 3
    UNION ALL SELECT 'unauthorized_privileged_operation', 'Critical', timestamp FROM d
        WHERE (action LIKE '%delete%' OR action LIKE '%admin%' OR action LIKE '%root%') AND id % 6 <> 0
    UNION ALL SELECT 'off_hours_data_access', 'Medium', timestamp FROM d
        WHERE event_type = 'DataAccess' AND (hour(timestamp) < 6 OR hour(timestamp) > 22)
    UNION ALL SELECT 'high_risk_without_approval', 'High', timestamp FROM d
        WHERE risk_level IN ('High', 'Critical') AND id % 4 <> 0
    UNION ALL SELECT 'suspicious_geographic_access', 'High', timestamp FROM d WHERE id % 50 = 0
    UNION ALL SELECT 'rapid_consecutive_operations', 'Medium', timestamp FROM d WHERE id % 10 = 0
    UNION ALL SELECT 'incomplete_audit_trail', 'Critical', timestamp FROM d WHERE chain_hash = '' OR previous_hash IS NULL
    UNION ALL SELECT 'policy_violation', 'High', timestamp FROM d WHERE outcome = 'Blocked' AND id % 8 = 0
    UNION ALL SELECT 'missing_session_tracking', 'Medium', timestamp FROM d
        WHERE session_id IS NULL AND event_type IN ('Authentication', 'Authorization')
    UNION ALL SELECT 'untracked_tool_execution', 'Low', timestamp FROM d
        WHERE event_type = 'ToolExecution' AND tool_name IS NULL)
    """


_DETAILED_SQL = _detailed_sql()


def _scored(spark, sf_dir):
    df = security_view(spark, sf_dir)
    return df.withColumn("risk_score", sec.risk_score()).withColumn("outcome", sec.event_outcome())


_SCORED_SQL = SECURITY + f", scored AS (SELECT *, {_RISK_SQL} AS risk_score, {_OUTCOME_SQL} AS outcome FROM sec) "


def audit_filter(spark, sf_dir):
    df = op.audit_filter(
        audit_view(spark, sf_dir),
        start=START,
        end=END,
        event_types=["UserAction", "DataAccess", "SystemError"],
        outcomes=["Success", "Failure"],
        risk_levels=["Medium", "High", "Critical"],
        resources=[f"res_{n}" for n in range(15)],
        actions=["click", "error"],
    )
    return df.select("id", stamp("timestamp").alias("at"), "actor", "resource", "outcome", "risk_level")


def audit_tags_all(spark, sf_dir):
    df = op.audit_filter(audit_view(spark, sf_dir), tags=["t1", "view"])
    return df.select("id", "actor", "action")


def security_filter(spark, sf_dir):
    df = op.security_filter(
        _scored(spark, sf_dir),
        start=START,
        end=END,
        event_types=["threat_detected", "policy_violation"],
        outcome="Warning",
        min_risk=75,
    )
    return df.select("id", "user_id", "risk_score", stamp("timestamp").alias("at"))


def test_data_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    named = c.select(
        n.alias("id"),
        F.when(n % 9 == 0, F.concat(F.lit("agent"), (n % 1000).cast("string")))
        .when(n % 9 == 1, F.concat(F.lit("mock_"), F.col("c_name")))
        .otherwise(F.col("c_name"))
        .alias("actor"),
        F.when(n % 12 == 5, "demo_file").otherwise(F.col("c_mktsegment")).alias("resource"),
        F.lit("read").alias("action"),
    )
    return op.flag_test_rows(named).select("id", "actor", "is_test")




def audit_performance(spark, sf_dir):
    out = op.audit_performance(audit_view(spark, sf_dir))
    return out.select(
        F.round("avg_execution_time_ms", 6).alias("avg_execution_time_ms"),
        "max_execution_time_ms",
        "total_operations",
        F.round("avg_memory_usage_mb", 6).alias("avg_memory_usage_mb"),
        "peak_memory_usage_mb",
        F.round("error_rate", 6).alias("error_rate"),
    )


def audit_report(spark, sf_dir):
    parts = op.audit_report(_detailed(spark, sf_dir), START, END)
    shape = lambda part, name, value: parts[part].select(
        F.lit(part).alias("part"), name.cast("string").alias("name"), value.cast("double").alias("value")
    )
    c = F.col
    return (
        shape("counts", F.concat_ws(":", "dimension", "value"), c("events"))
        .unionByName(shape("top_actors", c("actor"), c("events")))
        .unionByName(shape("top_resources", c("resource"), c("events")))
        .unionByName(shape("highlights", F.concat_ws(" - ", "event_type", "action"), c("events")))
        .unionByName(shape("performance", F.lit("error_rate"), F.round("error_rate", 6)))
        .unionByName(shape("violations", c("rule"), c("violations")))
        .unionByName(shape("score", F.lit("compliance_score"), F.round("compliance_score", 6)))
    )


_SCORE_SQL = """greatest(0, 100.0 * count_if(outcome <> 'Failure') / count(*) - (
    SELECT sum(CASE severity WHEN 'Critical' THEN 5.0 WHEN 'High' THEN 3.0 WHEN 'Medium' THEN 1.5 ELSE 0.5 END)
    FROM (SELECT DISTINCT rule, severity FROM hits)))"""


def compliance_violations(spark, sf_dir):
    out = op.compliance_violations(_detailed(spark, sf_dir))
    return out.select("rule", "severity", "violations", stamp("last_occurrence").alias("last_occurrence"))


def compliance_score(spark, sf_dir):
    out = op.compliance_score(_detailed(spark, sf_dir))
    return out.withColumn("compliance_score", F.round("compliance_score", 6))


def security_highlights(spark, sf_dir):
    out = op.security_highlights(audit_view(spark, sf_dir))
    return out.select(
        "event_type",
        "action",
        "events",
        stamp("first_occurrence").alias("first_occurrence"),
        stamp("last_occurrence").alias("last_occurrence"),
        "affected_resources",
        "severity",
    )


def _actions_as_text(df):
    pairs = F.transform("top_actions", lambda a: F.concat_ws(": ", a["action"], a["events"].cast("string")))
    return df.withColumn("top_actions", F.array_join(pairs, ", "))


def security_stats(spark, sf_dir):
    return op.security_stats(_scored(spark, sf_dir))


def security_metrics_24h(spark, sf_dir):
    df = security_view(spark, sf_dir)
    sessions = df.withColumn(
        "session_id", F.when(F.col("id") % 7 != 0, F.concat_ws("_", F.lit("s"), "uid", F.col("id") % 5))
    ).withColumn(
        "expires_at",
        F.when(F.col("uid") % 25 != 0, F.col("timestamp") + F.expr("INTERVAL 8 HOURS")),
    )
    return op.security_metrics(sessions, NOW)


# ---- chains: one log per user; a few stored rows are altered afterwards


def _logged(spark, sf_dir):
    return audit_view(spark, sf_dir).withColumn("log_id", F.col("user_id"))


def _tampered(spark, sf_dir):
    df = _logged(spark, sf_dir)
    chain = op.build_chain(df)
    altered = F.when(F.col("id") % 397 == 5, F.concat("action", F.lit("!"))).otherwise(F.col("action"))
    return df.join(chain.drop("log_id"), "id").withColumn("action", altered)


_CONTENT_SQL = """CAST(id AS VARCHAR) || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f+00:00') || event_type || actor
    || resource || action || outcome || risk_level"""
_CHAIN_SQL = f"""WITH RECURSIVE audit AS ({AUDIT_SQL}),
    ranked AS (SELECT *, user_id AS log_id, {_CONTENT_SQL} AS content,
        row_number() OVER (PARTITION BY user_id ORDER BY timestamp, id) - 1 AS seq FROM audit),
    chain AS (
      SELECT log_id, id, seq, CAST(NULL AS VARCHAR) AS previous_hash, sha256(content) AS chain_hash
      FROM ranked WHERE seq = 0
      UNION ALL
      SELECT r.log_id, r.id, r.seq, c.chain_hash, sha256(r.content || c.chain_hash)
      FROM chain c JOIN ranked r ON r.log_id = c.log_id AND r.seq = c.seq + 1)"""
_TAMPER_SQL = (
    _CHAIN_SQL
    + f""", stored AS (SELECT r.* REPLACE (CASE WHEN r.id % 397 = 5 THEN action || '!' ELSE action END AS action),
        c.previous_hash, c.chain_hash FROM ranked r JOIN chain c USING (id)),
    stored2 AS (SELECT *, {_CONTENT_SQL} AS now_content FROM stored)"""
)


def chain_build(spark, sf_dir):
    return op.build_chain(_logged(spark, sf_dir))


def chain_verify(spark, sf_dir):
    return op.verify_chain(_tampered(spark, sf_dir))


def chain_integrity_period(spark, sf_dir):
    """Logs are short here, so checkpoints are close."""
    marks = op.chain_checkpoints(op.build_chain(_logged(spark, sf_dir)), every=16)
    return op.verify_period(_tampered(spark, sf_dir), START, END, checkpoints=marks, every=16)


def log_digest(spark, sf_dir):
    return op.log_digest(_logged(spark, sf_dir))


def rapid_ops(spark, sf_dir):
    gap = 600 * 1_000_000  # events are sparse: ten minutes instead of one second
    out = op.rapid_ops(audit_view(spark, sf_dir), gap=gap)
    return out.select("id", "actor", "gap_us")


def paged(spark, sf_dir):
    df = op.audit_filter(audit_view(spark, sf_dir), risk_levels=["High"])
    return op.page(df, offset=20, limit=25).select("id", stamp("timestamp").alias("at"), "actor")


def retention(spark, sf_dir):
    df = audit_view(spark, sf_dir)
    kept = op.apply_retention(df, NOW, days=10)
    by_day = kept.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("kept"))
    gone = op.purged_count(df, NOW, days=10, inclusive=True)
    return by_day.unionByName(gone.select(F.lit("purged").alias("day"), F.col("purged").alias("kept")))


def risk_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "event_type", "risk_score")


def event_outcome(spark, sf_dir):
    return _scored(spark, sf_dir).select("id", "event_type", "outcome")


def event_flatten(spark, sf_dir):
    df = security_view(spark, sf_dir)
    typed = lambda name: F.col("event_type") == name
    wide = df.select(
        "id",
        "event_type",
        "user_id",
        F.when(typed("authorization") | typed("data_access"), F.col("resource")).alias("resource"),
        F.when(typed("authentication"), F.when(F.col("flag"), "password").otherwise("token")).alias("method"),
        F.when(typed("authentication") & (F.col("id") % 2 == 0), F.concat(F.lit("10.0.0."), F.col("id") % 250)).alias(
            "ip_address"
        ),
        F.when(typed("authorization"), "read").when(typed("data_access"), "scan").alias("action"),
        "grade",
        F.when(typed("threat_detected"), "probe").alias("threat_type"),
        F.when(typed("threat_detected"), F.from_json("props", "map<string,string>")).alias("details"),
        F.when(typed("policy_violation"), "spend").alias("policy"),
        F.when(typed("policy_violation"), "limit").alias("violation_type"),
    )
    flat = sec.flatten_events(wide)
    return flat.select(
        "id", "user_id", "resource", "action", "ip_address", F.explode("metadata").alias("meta_key", "meta_value")
    )


QUERIES = {
    "audit_filter": audit_filter,
    "audit_tags_all": audit_tags_all,
    "security_filter": security_filter,
    "test_data_rows": test_data_rows,
    "audit_counts": lambda s, d: op.audit_counts(audit_view(s, d)),
    "top_actors": lambda s, d: op.top_n(audit_view(s, d), "actor", 10),
    "audit_performance": audit_performance,
    "compliance_violations": compliance_violations,
    "compliance_score": compliance_score,
    "security_highlights": security_highlights,
    "security_stats": security_stats,
    "audit_summary": lambda s, d: _actions_as_text(op.audit_summary(audit_view(s, d))),
    "audit_range": lambda s, d: _actions_as_text(op.audit_range(audit_view(s, d))),
    "audit_report": audit_report,
    "security_metrics_24h": security_metrics_24h,
    "paged": paged,
    "chain_build": chain_build,
    "chain_verify": chain_verify,
    "chain_integrity_period": chain_integrity_period,
    "log_digest": log_digest,
    "rapid_ops": rapid_ops,
    "retention": retention,
    "risk_score": risk_score,
    "event_outcome": event_outcome,
    "event_flatten": event_flatten,
}

_token_sql = " OR ".join(f"contains({c}, '{t}')" for c in ("actor", "resource", "action") for t in TEST_TOKENS)

ORACLE = {
    "audit_filter": AUDIT
    + f"""SELECT id, strftime(timestamp, '{SQL_STAMP}') AS at, actor, resource, outcome, risk_level FROM audit
        WHERE {PERIOD} AND event_type IN ('UserAction', 'DataAccess', 'SystemError') AND outcome IN ('Success', 'Failure')
        AND risk_level IN ('Medium', 'High', 'Critical') AND action IN ('click', 'error')
        AND CAST(substr(resource, 5) AS INTEGER) < 15""",
    "audit_tags_all": AUDIT + "SELECT id, actor, action FROM audit WHERE id % 3 = 1 AND action = 'view'",
    "security_filter": _SCORED_SQL
    + f"""SELECT id, user_id, risk_score, strftime(timestamp, '{SQL_STAMP}') AS at FROM scored WHERE {CLOSED}
        AND event_type IN ('threat_detected', 'policy_violation') AND outcome = 'Warning' AND risk_score >= 75""",
    "test_data_rows": f"""WITH named AS (SELECT c_custkey AS id,
        CASE WHEN c_custkey % 9 = 0 THEN 'agent' || CAST(c_custkey % 1000 AS VARCHAR)
             WHEN c_custkey % 9 = 1 THEN 'mock_' || c_name ELSE c_name END AS actor,
        CASE WHEN c_custkey % 12 = 5 THEN 'demo_file' ELSE c_mktsegment END AS resource, 'read' AS action FROM customer)
        SELECT id, actor, ({_token_sql}) OR (regexp_full_match(actor, 'agent[0-9]+') AND strlen(actor) <= 7) AS is_test
        FROM named""",
    "audit_counts": AUDIT
    + f"""SELECT 'type' AS dimension, event_type AS value, count(*) AS events FROM audit GROUP BY 2
        UNION ALL SELECT 'outcome', outcome, count(*) FROM audit GROUP BY 2
        UNION ALL SELECT 'risk', risk_level, count(*) FROM audit GROUP BY 2""",
    "top_actors": AUDIT
    + f"SELECT actor, count(*) AS events FROM audit GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "audit_performance": AUDIT
    + f"""SELECT round(avg(execution_time_ms), 6) AS avg_execution_time_ms, max(execution_time_ms) AS max_execution_time_ms,
        count(execution_time_ms) AS total_operations,
        round(CAST(sum(memory_usage_mb) AS DOUBLE) / count(*), 6) AS avg_memory_usage_mb,
        max(memory_usage_mb) AS peak_memory_usage_mb,
        round(CAST(count_if(outcome = 'Failure') AS DOUBLE) / count(*), 6) AS error_rate FROM audit""",
    "compliance_violations": _DETAILED_SQL
    + f"""SELECT rule, severity, count(*) AS violations, strftime(max(timestamp), '{SQL_STAMP}') AS last_occurrence
        FROM hits GROUP BY 1, 2""",
    "compliance_score": _DETAILED_SQL
    + f"""SELECT count(*) AS total_checks, CAST(count_if(outcome <> 'Failure') AS BIGINT) AS passed_checks,
        CAST(count_if(outcome = 'Failure') AS BIGINT) AS failed_checks,
        round(CAST({_SCORE_SQL} AS DOUBLE), 6) AS compliance_score FROM d""",
    "security_highlights": AUDIT
    + f"""SELECT event_type, action, count(*) AS events, strftime(min(timestamp), '{SQL_STAMP}') AS first_occurrence,
        strftime(max(timestamp), '{SQL_STAMP}') AS last_occurrence, count(DISTINCT resource) AS affected_resources,
        arg_max(risk_level, timestamp) AS severity FROM audit
        WHERE risk_level IN ('High', 'Critical') GROUP BY 1, 2""",
    "security_stats": _SCORED_SQL
    + f""", p AS (SELECT *, CASE WHEN risk_score <= 25 THEN 'low' WHEN risk_score <= 50 THEN 'medium'
        WHEN risk_score <= 75 THEN 'high' ELSE 'critical' END AS band FROM scored)
        SELECT 'type' AS dimension, event_type AS value, count(*) AS events FROM p GROUP BY 2
        UNION ALL SELECT 'outcome', outcome, count(*) FROM p GROUP BY 2
        UNION ALL SELECT 'user', user_id, count(*) FROM p WHERE user_id IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'risk_band', band, count(*) FROM p GROUP BY 2""",
    "audit_summary": AUDIT
    + """SELECT count(*) AS total_events, CAST(count_if(outcome = 'Success') AS BIGINT) AS successful,
        CAST(count_if(outcome = 'Failure') AS BIGINT) AS failed,
        CAST(count_if(outcome = 'Blocked') AS BIGINT) AS violations, (SELECT string_agg(action || ': ' || n, ', ' ORDER BY n DESC, action)
            FROM (SELECT action, count(*) AS n FROM audit GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)) AS top_actions FROM audit""",
    "audit_range": AUDIT
    + """SELECT strftime(min(timestamp), '%Y-%m-%d') AS first_day, strftime(max(timestamp), '%Y-%m-%d') AS last_day,
        count(*) AS total_events, (SELECT string_agg(action || ': ' || n, ', ' ORDER BY n DESC, action)
            FROM (SELECT action, count(*) AS n FROM audit GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) AS top_actions FROM audit""",
    "audit_report": _detailed_sql(_WHERE_PERIOD)
    + f"""SELECT 'counts' AS part, 'type:' || event_type AS name, CAST(count(*) AS DOUBLE) AS value FROM d GROUP BY 2
        UNION ALL SELECT 'counts', 'outcome:' || outcome, count(*) FROM d GROUP BY 2
        UNION ALL SELECT 'counts', 'risk:' || risk_level, count(*) FROM d GROUP BY 2
        UNION ALL (SELECT 'top_actors', actor, count(*) FROM d GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
        UNION ALL (SELECT 'top_resources', resource, count(*) FROM d GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
        UNION ALL SELECT 'highlights', event_type || ' - ' || action, count(*) FROM d
            WHERE risk_level IN ('High', 'Critical') GROUP BY 2
        UNION ALL SELECT 'performance', 'error_rate', round(CAST(count_if(outcome = 'Failure') AS DOUBLE) / count(*), 6) FROM d
        UNION ALL SELECT 'violations', rule, count(*) FROM hits GROUP BY 2
        UNION ALL SELECT 'score', 'compliance_score', round(CAST({_SCORE_SQL} AS DOUBLE), 6) FROM d""",
    "security_metrics_24h": SECURITY
    + """, s AS (SELECT *, CASE WHEN id % 7 <> 0 THEN 's_' || uid || '_' || (id % 5) END AS session_id,
            CASE WHEN uid % 25 <> 0 THEN timestamp + INTERVAL 8 HOURS END AS expires_at FROM sec),
        k AS (SELECT * FROM s WHERE timestamp >= TIMESTAMP '2024-01-24 12:00:00')
        SELECT (SELECT count(*) FROM k WHERE event_type = 'authentication') AS authentication_events,
        (SELECT count(*) FROM k WHERE event_type = 'threat_detected') AS threats_detected,
        (SELECT count(*) FROM k WHERE event_type = 'policy_violation') AS policy_violations,
        (SELECT count(*) FROM (SELECT session_id FROM s WHERE session_id IS NOT NULL GROUP BY 1
            HAVING bool_or(expires_at IS NULL) OR max(expires_at) >= TIMESTAMP '2024-01-25 12:00:00')) AS active_sessions""",
    "paged": AUDIT
    + f"""SELECT id, strftime(timestamp, '{SQL_STAMP}') AS at, actor FROM audit WHERE risk_level = 'High'
        ORDER BY timestamp DESC, id LIMIT 25 OFFSET 20""",
    "chain_build": _CHAIN_SQL + " SELECT log_id, id, seq, previous_hash, chain_hash FROM chain",
    "chain_verify": _TAMPER_SQL
    + """ SELECT log_id, seq, id, 'chain_hash' AS reason FROM stored2
        WHERE sha256(now_content || coalesce(previous_hash, '')) <> chain_hash""",
    "chain_integrity_period": _TAMPER_SQL
    + f""", marked AS (SELECT log_id, timestamp, bool_or(id % 397 = 5)
            OVER (PARTITION BY log_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS bad FROM stored2)
        SELECT log_id, CAST(count_if({CLOSED}) AS BIGINT) AS total_entries,
        CAST(count_if({CLOSED} AND NOT bad) AS BIGINT) AS verified_entries,
        CAST(count_if({CLOSED} AND bad) AS BIGINT) AS corrupted_entries, NOT bool_or(bad) AS hash_chain_valid,
        count_if({CLOSED} AND bad) = 0 AS verified FROM marked GROUP BY log_id""",
    "log_digest": AUDIT
    + """SELECT user_id AS log_id, sha256(string_agg(strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f+00:00') || actor || action
        || outcome, '' ORDER BY timestamp, id)) AS digest FROM audit GROUP BY 1""",
    "rapid_ops": AUDIT
    + """, g AS (SELECT id, actor, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY actor
            ORDER BY timestamp, id) AS gap_us FROM audit)
        SELECT id, actor, gap_us FROM g WHERE gap_us < 600000000""",
    "retention": AUDIT
    + """SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS kept FROM audit
        WHERE timestamp > TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1
        UNION ALL SELECT 'purged', count(*) FROM audit WHERE timestamp < TIMESTAMP '2024-01-15 12:00:00'""",
    "risk_score": _SCORED_SQL + "SELECT id, event_type, risk_score FROM scored",
    "event_outcome": _SCORED_SQL + "SELECT id, event_type, outcome FROM scored",
    "event_flatten": SECURITY
    + """, m AS (
        SELECT id, 'auth_method' AS meta_key, CASE WHEN flag THEN 'password' ELSE 'token' END AS meta_value
            FROM sec WHERE event_type = 'authentication'
        UNION ALL SELECT id, 'ip_address', '10.0.0.' || (id % 250) FROM sec WHERE event_type = 'authentication' AND id % 2 = 0
        UNION ALL SELECT id, 'action', 'read' FROM sec WHERE event_type = 'authorization'
        UNION ALL SELECT id, 'operation', 'scan' FROM sec WHERE event_type = 'data_access'
        UNION ALL SELECT id, 'classification', grade FROM sec WHERE event_type = 'data_access'
        UNION ALL SELECT id, 'threat_type', 'probe' FROM sec WHERE event_type = 'threat_detected'
        UNION ALL SELECT id, 'k', json_extract_string(props, '$.k') FROM sec WHERE event_type = 'threat_detected'
        UNION ALL SELECT id, 'policy', 'spend' FROM sec WHERE event_type = 'policy_violation'
        UNION ALL SELECT id, 'violation_type', 'limit' FROM sec WHERE event_type = 'policy_violation')
        SELECT sec.id, user_id, CASE WHEN event_type IN ('authorization', 'data_access') THEN resource END AS resource,
        CASE event_type WHEN 'authorization' THEN 'read' WHEN 'data_access' THEN 'scan'
            WHEN 'policy_violation' THEN 'limit' END AS action,
        CASE WHEN event_type = 'authentication' AND sec.id % 2 = 0 THEN '10.0.0.' || (sec.id % 250) END AS ip_address,
        meta_key, meta_value FROM sec JOIN m USING (id)""",
}
