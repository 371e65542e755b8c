"""Audit-log filtering, reports, compliance, hash chains and retention."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.fixed_values import PENALTY, TEST_TOKENS
from tidemark.operators.ordering import MICROS, micros, moment, ordered_fold, split_by_time
from tidemark.session import cut_lineage

# ------------------------------------------------------------------ filters


def audit_filter(
    df: DataFrame,
    *,
    start=None,
    end=None,
    event_types: Sequence[str] | None = None,
    outcomes: Sequence[str] | None = None,
    risk_levels: Sequence[str] | None = None,
    actors: Sequence[str] | None = None,
    resources: Sequence[str] | None = None,
    actions: Sequence[str] | None = None,
    tags: Sequence[str] | None = None,
    mission_id: str | None = None,
    correlation_id: str | None = None,
) -> DataFrame:
    """AND of the given criteria; time is half-open ``[start, end)``."""
    if start is not None:
        df = df.filter(F.col("timestamp") >= moment(start))
    if end is not None:
        df = df.filter(F.col("timestamp") < moment(end))
    lists = {
        "event_type": event_types,
        "outcome": outcomes,
        "risk_level": risk_levels,
        "actor": actors,
        "resource": resources,
        "action": actions,
    }
    for column, wanted in lists.items():
        if wanted is not None:
            df = df.filter(F.col(column).isin(list(wanted)))
    if tags:
        df = df.filter(has_all_tags(F.col("tags"), tags))
    if mission_id is not None:
        df = df.filter(F.col("mission_id") == mission_id)
    if correlation_id is not None:
        df = df.filter(F.col("correlation_id") == correlation_id)
    return df


def has_all_tags(tags: Column, wanted: Sequence[str]) -> Column:
    asked = F.array(*[F.lit(t) for t in wanted])
    return F.size(F.array_except(asked, F.coalesce(tags, F.array().cast("array<string>")))) == 0


def security_filter(
    df: DataFrame,
    *,
    start,
    end,
    user_id: str | None = None,
    event_types: Sequence[str] = (),
    outcome: str | None = None,
    resource: str | None = None,
    min_risk: int | None = None,
) -> DataFrame:
    """Closed interval ``[start, end]``; an empty type list means any type."""
    df = df.filter(F.col("timestamp").between(moment(start), moment(end)))
    if user_id is not None:
        df = df.filter(F.col("user_id") == user_id)
    if event_types:
        df = df.filter(F.col("event_type").isin(list(event_types)))
    if outcome is not None:
        df = df.filter(F.col("outcome") == outcome)
    if resource is not None:
        df = df.filter(F.col("resource") == resource)
    if min_risk is not None:
        df = df.filter(F.col("risk_score") >= min_risk)
    return df


def flag_test_rows(df: DataFrame, columns=("actor", "resource", "action"), actor: str = "actor") -> DataFrame:
    """``is_test``: a test token in any column, or a short ``agent<digits>`` actor."""
    token = F.lit(False)
    for column in columns:
        for word in TEST_TOKENS:
            token = token | F.coalesce(F.col(column).contains(word), F.lit(False))
    numbered = F.coalesce(F.col(actor).rlike(r"^agent\+?[0-9]+$"), F.lit(False)) & (
        F.octet_length(actor) <= 7
    )
    return df.withColumn("is_test", token | numbered)


def page(df: DataFrame, offset: int = 0, limit: int | None = None, at: str = "timestamp", tie: str = "id"):
    """Newest first, ties by id; an offset past the end gives no rows."""
    ordered = df.orderBy(F.desc(at), F.asc(tie)).offset(offset)
    return ordered.limit(limit) if limit is not None else ordered


# ------------------------------------------------------------------ reports


def counts_by(df: DataFrame, **dimensions: Column) -> DataFrame:
    """Counts for several dimensions from one pass: (dimension, value, events)."""
    names = list(dimensions)
    keyed = df.select(*[c.cast("string").alias(n) for n, c in dimensions.items()])
    # one grouping set per dimension keeps the partial aggregate at O(distinct values)
    grouped = keyed.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(
        F.grouping_id(*names).alias("_gid"), F.count("*").alias("events")
    )
    full = (1 << len(names)) - 1
    which = value = None
    for i, name in enumerate(names):
        hit = F.col("_gid") == (full & ~(1 << (len(names) - 1 - i)))
        which = F.when(hit, name) if which is None else which.when(hit, name)
        value = F.when(hit, F.col(name)) if value is None else value.when(hit, F.col(name))
    return grouped.select(which.alias("dimension"), value.alias("value"), "events")


def audit_counts(df: DataFrame) -> DataFrame:
    return counts_by(
        df, type=F.col("event_type"), outcome=F.col("outcome"), risk=F.col("risk_level")
    )


def top_n(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return (
        df.groupBy(column).agg(F.count("*").alias("events")).orderBy(F.desc("events"), F.asc(column)).limit(n)
    )


def top_n_of(counts: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` largest of rows that are counted already."""
    return counts.select(column, "events").orderBy(F.desc("events"), F.asc(column)).limit(n)


def _outcome_sums() -> list[Column]:
    return [F.count("*").alias("rows"), F.count_if(F.col("outcome") == "Failure").alias("failed")]


def _performance_sums() -> list[Column]:
    return [
        *_outcome_sums(), F.avg("execution_time_ms").alias("time_avg"), F.max("execution_time_ms").alias("time_max"),
        F.count("execution_time_ms").alias("timed"), F.sum("memory_usage_mb").alias("memory"), F.max("memory_usage_mb").alias("memory_max"),
    ]


def _performance_of(sums: DataFrame) -> DataFrame:
    rows = F.col("rows")
    return sums.select(
        F.coalesce("time_avg", F.lit(0.0)).alias("avg_execution_time_ms"),
        F.coalesce("time_max", F.lit(0)).alias("max_execution_time_ms"),
        F.col("timed").alias("total_operations"),
        F.when(rows > 0, F.coalesce("memory", F.lit(0)) / rows).otherwise(0.0).alias("avg_memory_usage_mb"),
        F.coalesce("memory_max", F.lit(0)).alias("peak_memory_usage_mb"),
        F.when(rows > 0, F.col("failed") / rows).otherwise(0.0).alias("error_rate"),
    )


def audit_performance(df: DataFrame) -> DataFrame:
    """Memory is averaged over all rows, time only over the rows that have one."""
    return _performance_of(df.agg(*_performance_sums()))


def _rules() -> list[tuple[str, str, Column]]:
    """(rule, severity, condition) of the ten compliance checks."""
    detail = lambda key: F.try_element_at(F.col("details"), F.lit(key))
    lacks = lambda key: detail(key).isNull()
    privileged = F.lit(False)
    for word in ("delete", "admin", "root"):
        privileged = privileged | F.col("action").contains(word)
    anonymised = F.lit(False)
    for word in ("suspicious", "tor", "proxy"):
        anonymised = anonymised | detail("geo_location").contains(word)
    since = micros(F.col("timestamp")) - F.unix_micros(F.try_to_timestamp(detail("previous_action_timestamp")))
    severe = F.col("risk_level").isin("High", "Critical")
    return [
        (
            "excessive_failed_attempts",
            "High",
            (F.col("outcome") == "Failure") & (detail("failed_attempts").try_cast("bigint") > 3),
        ),
        (
            "unauthorized_privileged_operation",
            "Critical",
            privileged & lacks("authorization_token") & lacks("admin_approval"),
        ),
        (
            "off_hours_data_access",
            "Medium",
            (F.col("event_type") == "DataAccess") & ~F.hour("timestamp").between(6, 22),
        ),
        (
            "high_risk_without_approval",
            "High",
            severe & lacks("supervisor_approval") & lacks("emergency_override"),
        ),
        ("suspicious_geographic_access", "High", anonymised),
        ("rapid_consecutive_operations", "Medium", since < MICROS),
        (
            "incomplete_audit_trail",
            "Critical",
            (F.coalesce(F.col("chain_hash"), F.lit("")) == "") | F.col("previous_hash").isNull(),
        ),
        (
            "policy_violation",
            "High",
            (F.col("outcome") == "Blocked") & ~lacks("policy_violation"),
        ),
        (
            "missing_session_tracking",
            "Medium",
            F.col("session_id").isNull() & F.col("event_type").isin("Authentication", "Authorization"),
        ),
        (
            "untracked_tool_execution",
            "Low",
            (F.col("event_type") == "ToolExecution") & F.col("tool_name").isNull(),
        ),
    ]


def _rule_sums() -> list[Column]:
    aggs = []
    for i, (_, _, hit) in enumerate(_rules()):
        aggs += [F.count_if(hit).alias(f"n{i}"), F.max(F.when(hit, F.col("timestamp"))).alias(f"t{i}")]
    return aggs


def _violations_of(sums: DataFrame) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(rule).alias("rule"),
                F.lit(severity).alias("severity"),
                F.col(f"n{i}").alias("violations"),
                F.col(f"t{i}").alias("last_occurrence"),
            )
            for i, (rule, severity, _) in enumerate(_rules())
        ]
    )
    return sums.select(F.inline(rows)).filter(F.col("violations") > 0)


def compliance_violations(df: DataFrame) -> DataFrame:
    """(rule, severity, violations, last_occurrence) per violated rule.

    One aggregate with a conditional count and maximum per rule: a row never
    multiplies, and only one row per task is shuffled.
    """
    return _violations_of(df.agg(*_rule_sums()))


def _score_of(sums: DataFrame) -> DataFrame:
    penalty = sum(
        (F.when(F.col(f"n{i}") > 0, PENALTY[severity]).otherwise(0.0) for i, (_, severity, _) in enumerate(_rules())),
        F.lit(0.0),
    )
    checks, failed = F.col("rows"), F.col("failed")
    return sums.select(
        checks.alias("total_checks"),
        (checks - failed).alias("passed_checks"),
        failed.alias("failed_checks"),
        F.when(checks == 0, 100.0)
        .otherwise(F.greatest(F.lit(0.0), (checks - failed) / checks * 100.0 - penalty))
        .alias("compliance_score"),
    )


def compliance_score(df: DataFrame) -> DataFrame:
    """``max(0, 100 * passed / all - penalty per violated rule)``; 100 when empty."""
    return _score_of(df.agg(*_outcome_sums(), *_rule_sums()))


def security_highlights(df: DataFrame) -> DataFrame:
    """High and Critical rows per (type, action), most frequent first.

    Distinct resources are counted in two partial steps, so no set of resources
    is gathered in one place; severity is that of the newest row.
    """
    severe = df.filter(F.col("risk_level").isin("High", "Critical"))
    per_resource = severe.groupBy("event_type", "action", "resource").agg(
        F.count("*").alias("n"),
        F.min("timestamp").alias("first"),
        F.max("timestamp").alias("last"),
        F.max(F.struct("timestamp", "id", "risk_level")).alias("newest"),
    )
    return (
        per_resource.groupBy("event_type", "action")
        .agg(
            F.sum("n").alias("events"),
            F.min("first").alias("first_occurrence"),
            F.max("last").alias("last_occurrence"),
            F.count("*").alias("affected_resources"),
            F.max("newest").getField("risk_level").alias("severity"),
        )
        .orderBy(F.desc("events"), "event_type", "action")
    )


def security_stats(df: DataFrame) -> DataFrame:
    band = (
        F.when(F.col("risk_score") <= 25, "low")
        .when(F.col("risk_score") <= 50, "medium")
        .when(F.col("risk_score") <= 75, "high")
        .otherwise("critical")
    )
    counted = counts_by(
        df, type=F.col("event_type"), outcome=F.col("outcome"), user=F.col("user_id"), risk_band=band
    )
    return counted.filter(~((F.col("dimension") == "user") & F.col("value").isNull()))


def _with_top_actions(counts: DataFrame, totals: dict[str, Column], n: int) -> DataFrame:
    """One row: totals of the counts per action, and the ``n`` most frequent actions as (action, events)."""
    top = top_n_of(counts, "action", n)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("events")).alias("o"), "action", "events")))
    actions = top.agg(F.transform(listed, lambda a: F.struct(a["action"].alias("action"), a["events"].alias("events"))).alias("top_actions"))
    return counts.agg(*[v.alias(k) for k, v in totals.items()]).join(actions)


def audit_summary(df: DataFrame) -> DataFrame:
    """Totals and the five most frequent actions."""
    outcome = F.lower("outcome")
    counts = df.groupBy("action").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("outcome").isin("success", "Success")).alias("s"),
        F.count_if(F.col("outcome").isin("failure", "Failure")).alias("f"),
        F.count_if(outcome.contains("violation") | outcome.contains("blocked")).alias("v"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return _with_top_actions(counts, {"total_events": total("events"), "successful": total("s"), "failed": total("f"), "violations": total("v")}, 5)


def audit_range(df: DataFrame) -> DataFrame:
    """First and last day, total and the ten most frequent actions."""
    counts = df.groupBy("action").agg(F.count("*").alias("events"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    totals = {"first_day": day(F.min("a")), "last_day": day(F.max("b")), "total_events": F.coalesce(F.sum("events"), F.lit(0)).cast("long")}
    return _with_top_actions(counts, totals, 10)


def audit_report(df: DataFrame, start, end) -> dict[str, DataFrame]:
    """All report parts for ``[start, end)`` from three scans of the pruned period.

    One aggregate holds performance and every rule, one set of grouped counts all tallies; both are small and
    written once, and the parts are views of them. Highlights count resources of severe rows only.
    """
    period = audit_filter(df, start=start, end=end)
    sums = cut_lineage(period.agg(*_performance_sums(), *_rule_sums()))
    tallies = cut_lineage(counts_by(
        period, type=F.col("event_type"), outcome=F.col("outcome"), risk=F.col("risk_level"), actor=F.col("actor"), resource=F.col("resource")))
    kinds = dict(df.dtypes)
    tally = lambda name: tallies.filter(F.col("dimension") == name).select(F.col("value").cast(kinds[name]).alias(name), "events")
    return {
        "counts": tallies.filter(F.col("dimension").isin("type", "outcome", "risk")),
        "top_actors": top_n_of(tally("actor"), "actor", 10),
        "top_resources": top_n_of(tally("resource"), "resource", 10),
        "highlights": security_highlights(period),
        "performance": _performance_of(sums),
        "violations": _violations_of(sums),
        "score": _score_of(sums),
    }


def security_metrics(df: DataFrame, now, hours: int = 24) -> DataFrame:
    """Events of the closing ``hours`` by stored type name, plus active sessions."""
    recent = F.col("timestamp") >= moment(now) - F.expr(f"INTERVAL {int(hours)} HOURS")
    typed = lambda name: F.count_if(recent & (F.col("event_type") == name))
    sessions = (
        df.groupBy("session_id")
        .agg(
            F.max("expires_at").alias("expires_at"),
            F.count_if(F.col("expires_at").isNull()).alias("endless"),
            typed("authentication").alias("a"),
            typed("threat_detected").alias("t"),
            typed("policy_violation").alias("p"),
        )
    )
    live = F.col("session_id").isNotNull() & ((F.col("endless") > 0) | (moment(now) <= F.col("expires_at")))
    return sessions.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("authentication_events"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("threats_detected"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("policy_violations"),
        F.count_if(live).alias("active_sessions"),
    )


# ------------------------------------------------------------------ chains


def chain_content() -> Column:
    """Hashed fields of an entry, concatenated without separators."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00")
    return F.concat(
        F.col("id").cast("string"), stamp, "event_type", "actor", "resource", "action", "outcome", "risk_level"
    )


def _hashed(content: str, previous: str | None) -> str:
    return hashlib.sha256((content + (previous or "")).encode()).hexdigest()


def build_chain(
    df: DataFrame, log: str = "log_id", order: Sequence[str] = ("timestamp", "id"), content: Column | None = None,
    tails: DataFrame | None = None,
) -> DataFrame:
    """(log, id, seq, previous_hash, chain_hash), chained in order within each log.

    A hash chain is serial by definition, so a log is one ordered stream; only
    the key, the order and the content string travel to it, and the state is
    the last hash. ``tails`` (log, seq, chain_hash) holds the last stored entry
    of logs that go on; their new rows follow it. Other logs start afresh.
    """
    order = list(order)
    narrow = df.select(log, "id", *[c for c in order if c != "id"], (content or chain_content()).alias("content"))
    goes_on = tails is not None
    if goes_on:
        last_of = tails.select(F.col(log).alias("_of"), F.col("seq").alias("_seq"), F.col("chain_hash").alias("_hash"))
        narrow = narrow.join(last_of, F.col(log).eqNullSafe(F.col("_of")), "left").drop("_of")

    def step(state, contents, *tail):
        seq, last = state
        if goes_on and last is None and tail[1][0] is not None:
            seq, last = tail[0][0] + 1, tail[1][0]
        fresh = []
        before = last
        for text in contents:
            last = _hashed(text, last)
            fresh.append(last)
        return (seq + len(fresh), last), (list(range(seq, seq + len(fresh))), [before, *fresh[:-1]], fresh)

    kinds = dict(narrow.dtypes)
    schema = f"{log} {kinds[log]}, id {kinds['id']}, seq bigint, previous_hash string, chain_hash string"
    return ordered_fold(narrow, [log], order, ["content", *(["_seq", "_hash"] if goes_on else [])], lambda: (0, None), step, schema)


def verify_chain(df: DataFrame, log: str = "log_id", anchor: DataFrame | str | None = None, block: int = 100_000) -> DataFrame:
    """Rows that break the stored chain, with the reason.

    Each row needs only its stored neighbour: a window inside blocks of ``block`` sequence numbers, whose last
    row is also handed to the next block, so even one huge log is many tasks and the log is read once, plus
    once for its first number. After retention has dropped a prefix, ``anchor`` is the hash that the first
    survivor must point to: a table (log, anchor_hash) for many logs, or one value.
    """
    own = F.floor(F.col("seq") / block)
    rows = df.withColumn("_content", chain_content()).withColumn(
        "_block", F.explode(F.when(F.col("seq") % block == block - 1, F.array(own, own + 1)).otherwise(F.array(own))))
    before = Window.partitionBy(log, "_block").orderBy("seq")
    near = (F.lag("seq").over(before) == F.col("seq") - 1)
    known = rows.withColumn("_expected", F.when(near, F.lag("chain_hash").over(before))).where(F.col("_block") == own)
    first = df.groupBy(F.col(log).alias("_log")).agg(F.min("seq").alias("_first"))
    if isinstance(anchor, DataFrame):
        first = first.join(anchor.select(F.col(log).alias("_of"), "anchor_hash"), F.col("_log").eqNullSafe(F.col("_of")), "left").drop("_of")
    else:
        first = first.withColumn("anchor_hash", F.lit(anchor).cast("string"))
    joined = known.join(first, F.col(log).eqNullSafe(F.col("_log")))
    expected = F.when(F.col("seq") == F.col("_first"), F.col("anchor_hash")).otherwise(F.col("_expected"))
    recomputed = F.sha2(
        F.concat(F.col("_content"), F.coalesce(F.col("previous_hash"), F.lit(""))).cast("binary"), 256
    )
    reason = F.when(~F.col("previous_hash").eqNullSafe(expected), "previous_hash").when(
        ~recomputed.eqNullSafe(F.col("chain_hash")), "chain_hash"
    )
    return joined.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(log, "seq", "id", "reason")


def chain_checkpoints(chain: DataFrame, every: int = 100_000, log: str = "log_id") -> DataFrame:
    """(log, segment, end_hash) of each finished run of ``every`` entries, to be kept where entries cannot be altered."""
    last = F.col("seq") % every == every - 1
    return chain.filter(last).select(log, F.floor(F.col("seq") / every).alias("segment"), F.col("chain_hash").alias("end_hash"))


def verify_period(
    df: DataFrame, start, end, log: str = "log_id", order: Sequence[str] = ("timestamp", "id"),
    checkpoints: DataFrame | None = None, every: int = 100_000, whole: bool = True,
) -> DataFrame:
    """Recompute every chain; per log the period's totals and the whole-chain flag.

    With ``checkpoints`` the segments of a log are recomputed in parallel, each from the checkpoint before it. Without
    ``whole`` only segments with entries of the period are read again, and the flag speaks of these.
    """
    inside = F.col("timestamp").between(moment(start), moment(end))
    if checkpoints is not None:
        rows = df.withColumn("_segment", F.floor(F.col("seq") / every))
        if not whole:
            asked = rows.filter(inside).select(F.col(log).alias("_of"), F.col("_segment").alias("_asked")).distinct()
            rows = rows.join(asked, F.col(log).eqNullSafe(F.col("_of")) & (F.col("_segment") == F.col("_asked")), "left_semi")
        return _period_of(_checked_segments(rows, log, checkpoints, whole, inside), log)
    bad = ~F.col("matches")
    return corrupted_entries(df, log, order).groupBy(log).agg(
        F.count_if(inside).alias("total_entries"),
        F.count_if(inside & ~bad).alias("verified_entries"),
        F.count_if(inside & bad).alias("corrupted_entries"),
        (F.count_if(bad) == 0).alias("hash_chain_valid"),
        (F.count_if(inside & bad) == 0).alias("verified"),
    )


def _period_of(segments: DataFrame, log: str) -> DataFrame:
    total, verified = F.sum("_asked"), F.sum("_verified")
    return segments.groupBy(log).agg(
        total.alias("total_entries"),
        verified.alias("verified_entries"),
        (total - verified).alias("corrupted_entries"),
        (F.sum("_bad") == 0).alias("hash_chain_valid"),
        (total == verified).alias("verified"),
    )


def _checked_segments(rows: DataFrame, log: str, checkpoints: DataFrame, whole: bool, inside: Column) -> DataFrame:
    """(log, _segment, _asked, _verified, _bad): entries inside, those of them that match, and all that do not.

    Each segment is folded from the checkpoint before it, to one row. A segment that does not end at its own
    checkpoint has altered content, and what comes after it in the log is then no longer what a recomputed chain gives.
    """
    # read twice: where a segment begins, and where it should end
    marks = cut_lineage(checkpoints.select(F.col(log).alias("_of"), F.col("segment").alias("_done"), "end_hash"))
    of = F.col(log).eqNullSafe(F.col("_of"))
    begun = rows.join(marks, of & (F.col("_segment") == F.col("_done") + 1), "left").select(
        log, "_segment", "seq", "chain_hash", F.col("end_hash").alias("_begin"), chain_content().alias("content"),
        F.coalesce(inside, F.lit(False)).alias("_inside"))

    def step(state, contents, stored, begin, asked):
        last, n, n_asked, verified, bad = state
        if not n and begin[0] is not None:
            last = begin[0]
        for text, known, ask in zip(contents, stored, asked):
            last = _hashed(text, last)
            same = known == last
            n_asked += ask
            verified += ask and same
            bad += not same
        return (last, n + len(contents), n_asked, verified, bad), None

    kinds = dict(begun.dtypes)
    schema = f"{log} {kinds[log]}, _segment {kinds['_segment']}, _end string, _n bigint, _asked bigint, _verified bigint, _bad bigint"
    segments = ordered_fold(
        begun, [log, "_segment"], ["seq"], ["content", "chain_hash", "_begin", "_inside"], lambda: (None, 0, 0, 0, 0), step, schema, tuple)
    if not whole:
        return segments
    ends = segments.join(marks.withColumn("_marked", F.lit(True)), of & (F.col("_segment") == F.col("_done")), "left")
    wrong = F.col("_marked") & ~F.col("_end").eqNullSafe(F.col("end_hash"))
    first = F.min(F.when(wrong, F.col("_segment"))).over(Window.partitionBy(log))
    after = F.coalesce(F.col("_segment") > F.col("_first"), F.lit(False))
    return ends.withColumn("_first", first).select(
        log, "_segment", "_asked", F.when(after, 0).otherwise(F.col("_verified")).alias("_verified"), F.when(after, F.col("_n")).otherwise(F.col("_bad")).alias("_bad"))


def corrupted_entries(df: DataFrame, log: str = "log_id", order: Sequence[str] = ("timestamp", "id")) -> DataFrame:
    """Every stored row with ``matches``: its hash equals the recomputed chain's."""
    fresh = build_chain(df.drop("seq", "previous_hash"), log, order).select(
        F.col(log).alias("_of"), F.col("id").alias("_id"), F.col("chain_hash").alias("_fresh")
    )
    same = F.col(log).eqNullSafe(F.col("_of")) & F.col("id").eqNullSafe(F.col("_id"))
    return df.join(fresh, same, "left").drop("_of", "_id").withColumn(
        "matches", F.col("chain_hash").eqNullSafe(F.col("_fresh"))
    )


def log_digest(
    df: DataFrame, log: str = "log_id", order: Sequence[str] = ("timestamp", "id"), logs: DataFrame | None = None
) -> DataFrame:
    """One digest per log over the ordered timestamp, actor, action and outcome.

    ``logs`` names logs that may have no entry yet; theirs is the digest of an empty log.

    Streams the ordered rows into a running SHA-256; the concatenation itself
    is never built.
    """
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00")
    narrow = df.select(
        log, *order, F.concat(stamp, "actor", "action", "outcome").alias("content")
    )

    def step(state, contents):
        for text in contents:
            state.update(text.encode())
        return state, None

    kind = dict(narrow.dtypes)[log]
    found = ordered_fold(
        narrow, [log], list(order), ["content"], hashlib.sha256, step, f"{log} {kind}, digest string", lambda state: (state.hexdigest(),))
    if logs is None:
        return found
    named = logs.select(F.col(log).alias("_named")).distinct()
    both = named.join(found, F.col("_named").eqNullSafe(F.col(log)), "left")
    return both.select(F.col("_named").alias(log), F.coalesce("digest", F.lit(GENESIS_DIGEST)).alias("digest"))


GENESIS_DIGEST = "genesis"


def rapid_ops(df: DataFrame, key: str = "actor", gap: int = MICROS, slice_len: int = 3600 * MICROS) -> DataFrame:
    """Rows less than ``gap`` microseconds after the actor's previous action."""
    sliced = split_by_time(df, micros(F.col("timestamp")), gap, slice_len)
    order = Window.partitionBy(key, "_slice").orderBy("_at", "id")
    return (
        sliced.withColumn("gap_us", F.col("_at") - F.lag("_at").over(order))
        .filter(~F.col("_context") & (F.col("gap_us") < gap))
        .drop("_at", "_slice", "_context")
    )


# ---------------------------------------------------------------- retention


def apply_retention(df: DataFrame, now, days: int = 365, inclusive: bool = False) -> DataFrame:
    """Rows newer than ``now - days``; the purge variant also keeps the cutoff itself."""
    cutoff = moment(now) - F.expr(f"INTERVAL {int(days)} DAYS")
    at = F.col("timestamp")
    return df.filter(at >= cutoff if inclusive else at > cutoff)


def purged_count(df: DataFrame, now, days: int = 365, inclusive: bool = False) -> DataFrame:
    cutoff = moment(now) - F.expr(f"INTERVAL {int(days)} DAYS")
    gone = F.col("timestamp") < cutoff if inclusive else F.col("timestamp") <= cutoff
    return df.agg(F.count_if(gone).alias("purged"), F.count_if(~gone).alias("kept"))

