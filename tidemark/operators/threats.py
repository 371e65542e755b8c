"""Sliding-window detectors, request scanning, baselines and block lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.fixed_values import SCRIPT_PATTERNS, SQL_PATTERNS
from tidemark.operators.ordering import MICROS, micros, split_by_time

MINUTE = 60 * MICROS

# Equivalents of the listed patterns for a backtracking matcher. Each `.*x` is
# taken as the nearest x and never revisited: if any match exists on a line,
# one with the nearest x does too, and long lines stay linear.
_EXECUTED = {
    SQL_PATTERNS[4]: r"(?idmU)^[^'\n]*'(?>.*?or)(?>.*?')(?>.*?=)(?>.*?')",
    SCRIPT_PATTERNS[0]: r"(?idU)<script(?>.*?>)(?>.*?</script>)",
    SCRIPT_PATTERNS[3]: r"(?idU)<iframe(?>.*?src)(?>.*?>)",
}


def _executed(pattern: str) -> str:
    return _EXECUTED.get(pattern, pattern.replace("(?i)", "(?idU)"))


PANE = 16  # windows in a pane: about one row in 16 is also context of the next pane


def _running(df: DataFrame, source: str, windows: Sequence[tuple[str, Column, int]]) -> DataFrame:
    """Add, for each (name, amount, window), the sum of amounts of the source in ``(t - window, t]``.

    ``df`` has ``_at``. Rows are dealt once by (source, pane). Inside a pane every row enters at its time and
    leaves each window later, and one running sum over these moments, in order, gives all windows: no frame is
    ever summed again, so a flood costs no more than its rows. A source with a third of all rows is many panes.
    """
    longest = max(w for _, _, w in windows)
    sliced = split_by_time(df, F.col("_at"), longest, PANE * longest).repartition(source, "_slice")
    own = F.struct(*sliced.columns)
    amounts = {name: amount.cast("bigint") for name, amount, _ in windows}

    def moment(after: int, leaving: str | None) -> Column:
        # what leaves at a time goes before what enters at it
        change = [(F.lit(0) if leaving not in (None, name) else -a if leaving else a).cast("bigint").alias(name) for name, a in amounts.items()]
        return F.struct(((F.col("_at") + after) * 2 + (0 if leaving else 1)).alias("order"), *change, (F.lit(None).cast(kind) if leaving else own).alias("row"))

    kind = sliced.select(own.alias("r")).schema["r"].dataType
    moments = F.array(moment(0, None), *[moment(w, name) for name, _, w in windows])
    events = sliced.select(source, "_slice", F.explode(moments).alias("m"))
    upto = Window.partitionBy(source, "_slice").orderBy("m.order").rangeBetween(Window.unboundedPreceding, 0)
    summed = events.select("m.row", *[F.sum(f"m.{name}").over(upto).alias(f"_sum_{name}") for name in amounts])
    entered = summed.filter(F.col("row").isNotNull() & ~F.col("row._context"))
    return entered.select("row.*", *[F.col(f"_sum_{name}").alias(name) for name in amounts]).drop("_slice", "_context")


def sliding_count(
    df: DataFrame, source: str = "source", window: int = 5 * MINUTE, out: str = "events", at: str = "timestamp"
) -> DataFrame:
    """Rows of the same source in ``(t - window, t]`` for every row."""
    return _running(df.withColumn("_at", micros(F.col(at))), source, [(out, F.lit(1), window)]).drop("_at")


def brute_force(
    failures: DataFrame, source: str = "source", threshold: int = 5, window: int = 5 * MINUTE
) -> DataFrame:
    """Failures that make it ``threshold`` or more from one source within ``window``."""
    return sliding_count(failures, source, window, "attempts").filter(F.col("attempts") >= threshold)


def rate_abuse(requests: DataFrame, source: str = "source", limit: int = 100, window: int = MINUTE) -> DataFrame:
    """Requests that make it more than ``limit`` from one source within ``window``."""
    return sliding_count(requests, source, window, "requests").filter(F.col("requests") > limit)


def exfiltration(
    transfers: DataFrame, source: str = "source", size: str = "bytes", limit: float = 10_000_000, window: int = MINUTE
) -> DataFrame:
    """Source and time slot whose transferred bytes reach ``limit``."""
    slot = F.floor(micros(F.col("timestamp")) / F.lit(window)) * F.lit(window)
    return (
        transfers.groupBy(source, F.timestamp_micros(slot).alias("slot"))
        .agg(F.sum(size).alias("total_bytes"))
        .filter(F.col("total_bytes") >= limit)
    )


@dataclass(frozen=True)
class ThreatPattern:
    """``kind`` is failures, requests or bytes; ``window`` in microseconds."""

    id: str
    kind: str
    severity: str
    window: int
    threshold: float


# Default windowed patterns.
DEFAULT_PATTERNS = [
    ThreatPattern("brute_force_login", "failures", "High", 5 * MINUTE, 5),
    ThreatPattern("rate_limit_abuse", "requests", "Medium", MINUTE, 100),
    ThreatPattern("data_exfiltration", "bytes", "High", MINUTE, 10_000_000),
]


def detect(
    df: DataFrame,
    patterns: Sequence[ThreatPattern] = DEFAULT_PATTERNS,
    source: str = "source",
    failed: Column | None = None,
    size: str = "bytes",
) -> DataFrame:
    """(pattern, severity, source, detections, peak) for a table of patterns, in one pass over the rows.

    Rows of a source at one instant are combined before the shuffle. All windows that look back are one running
    sum; sums by time slot follow from the same instants. A detection is a row whose window reaches the limit,
    or a slot that does.
    """
    patterns = list(patterns)
    for p in patterns:
        if p.kind not in ("failures", "requests", "bytes"):
            raise ValueError(f"unknown pattern kind: {p.kind}")
    failed = failed if failed is not None else F.col("outcome") == "Failure"
    by_size = any(p.kind == "bytes" for p in patterns)
    instants = df.groupBy(source, micros(F.col("timestamp")).alias("_at")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(failed).alias("failures"), *([F.sum(size).cast("double").alias("bytes")] if by_size else []))
    parts = []
    counted = [p for p in patterns if p.kind != "bytes"]
    if counted:
        names = [f"_p{i}" for i in range(len(counted))]
        sums = _running(instants, source, [(n, F.col(p.kind), p.window) for n, p in zip(names, counted)])
        aggs = []
        for n, p in zip(names, counted):
            hit = (F.col(n) >= p.threshold if p.kind == "failures" else F.col(n) > p.threshold) & (F.col(p.kind) > 0)
            aggs += [F.sum(F.when(hit, F.col(p.kind))).alias(n + "n"), F.max(F.when(hit, F.col(n))).cast("double").alias(n + "m")]
        rows = F.array(*[F.struct(
            F.lit(p.id).alias("pattern"), F.lit(p.severity).alias("severity"), F.col(n + "n").alias("detections"), F.col(n + "m").alias("peak"))
            for n, p in zip(names, counted)])
        parts.append(sums.groupBy(source).agg(*aggs).select(source, F.inline(rows)).filter("detections IS NOT NULL"))
    for p in patterns:
        if p.kind == "bytes":
            slots = instants.groupBy(source, F.floor(F.col("_at") / p.window).alias("_slot")).agg(F.sum("bytes").alias("total")).filter(F.col("total") >= p.threshold)
            parts.append(slots.groupBy(source).agg(F.count(F.lit(1)).alias("detections"), F.max("total").alias("peak")).select(
                source, F.lit(p.id).alias("pattern"), F.lit(p.severity).alias("severity"), "detections", "peak"))
    return reduce(DataFrame.unionByName, parts)


def scan_requests(df: DataFrame, uri: str = "uri", body: str = "body") -> DataFrame:
    """First matching SQL pattern, else first script pattern, on ``uri + ' ' + body``."""
    content = F.concat(F.col(uri), F.lit(" "), F.coalesce(F.col(body), F.lit("")))
    kinds = [("sql_injection", "Critical", 0.9, SQL_PATTERNS), ("xss_attack", "High", 0.8, SCRIPT_PATTERNS)]
    hit = None
    for threat, severity, confidence, patterns in kinds:
        for pattern in patterns:
            found = F.struct(
                F.lit(threat).alias("threat_type"),
                F.lit(severity).alias("severity"),
                F.lit(confidence).alias("confidence"),
                F.lit(pattern).alias("matched_pattern"),
            )
            test = content.rlike(_executed(pattern))
            hit = F.when(test, found) if hit is None else hit.when(test, found)
    return df.withColumn("_hit", hit).filter(F.col("_hit").isNotNull()).select("*", "_hit.*").drop("_hit")


def geo_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Plane distance at 111 km per degree."""
    dlat, dlon = F.abs(lat1 - lat2), F.abs(lon1 - lon2)
    return F.sqrt(dlat * dlat + dlon * dlon) * 111.0


def baseline_anomalies(activity: DataFrame, baselines: DataFrame, max_km: float = 1000.0) -> DataFrame:
    """Activity far from every known place, else with an unseen agent.

    ``activity(user_id, lat, lon, user_agent)``; ``baselines(user_id, locations,
    user_agents)``. Users without a baseline give nothing; without a position
    only the agent is checked.
    """
    joined = activity.join(baselines, "user_id")
    far = F.col("lat").isNotNull() & F.forall(
        F.col("locations"), lambda p: geo_km(F.col("lat"), F.col("lon"), p["lat"], p["lon"]) > max_km
    )
    unseen = ~F.array_contains("user_agents", F.col("user_agent"))
    anomaly = F.when(far, "unusual_location").when(unseen, "unusual_user_agent")
    severity = F.when(far, "Medium").otherwise("Low")
    confidence = F.when(far, 0.6).otherwise(0.4)
    return (
        joined.withColumn("threat_type", anomaly)
        .filter(F.col("threat_type").isNotNull())
        .withColumn("severity", severity)
        .withColumn("confidence", confidence)
        .drop("locations", "user_agents")
    )


def blocklist_hits(df: DataFrame, blocklist: DataFrame, source: str = "source") -> DataFrame:
    """Rows whose source is listed; Spark broadcasts the list only while it is small."""
    return df.join(blocklist.select(source).distinct(), source, "left_semi")


_V4 = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"


def is_ip(value: Column) -> Column:
    """A literal IPv4 or IPv6 address."""
    six = F.regexp_replace(value, rf":{_V4}$", ":0:0")
    short = six.contains("::")
    groups = F.size(F.filter(F.split(six, ":"), lambda g: g != ""))
    shaped = six.rlike(rf"^(?:{_GROUPS})?(?:::(?:{_GROUPS})?)?$") & six.contains(":")
    v6 = shaped & ((short & (groups <= 7)) | (~short & (groups == 8)))
    return value.rlike(rf"^{_V4}$") | v6


def client_ip(headers: Column, trust_proxy: bool) -> Column:
    """First X-Forwarded-For entry, then X-Real-IP; null unless proxies are trusted."""
    if not trust_proxy:
        return F.lit(None).cast("string")
    lowered = F.transform_keys(headers, lambda k, _: F.lower(k))
    header = lambda name: F.try_element_at(lowered, F.lit(name))
    first = F.trim(F.split_part(header("x-forwarded-for"), F.lit(","), F.lit(1)))
    real = header("x-real-ip")
    return F.coalesce(F.when(is_ip(first), first), F.when(is_ip(real), real))
