"""Security-event columns: risk score, outcome and the flat event shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Score by event type and grade.
_GRADED = {
    "data_access": {"Public": 5, "Internal": 15, "Confidential": 30, "Restricted": 50, "TopSecret": 75},
    "threat_detected": {"Low": 30, "Medium": 50, "High": 75, "Critical": 95},
    "policy_violation": {"Minor": 20, "Major": 60, "Critical": 90},
}
_FLAGGED = {"authentication": (10, 40), "authorization": (5, 35)}
_OUTCOMES = {
    "authentication": ("Success", "Failure"),
    "authorization": ("Success", "Warning"),
    "data_access": ("Information", "Information"),
    "threat_detected": ("Warning", "Warning"),
    "policy_violation": ("Failure", "Failure"),
}


def _is(name: str) -> Column:
    return F.col("event_type") == name


def risk_score() -> Column:
    """Score from ``event_type``, ``flag`` (success or granted) and ``grade``."""
    cases = [(_is(kind), F.when(F.col("flag"), ok).otherwise(bad)) for kind, (ok, bad) in _FLAGGED.items()]
    cases += [
        (_is(kind) & (F.col("grade") == grade), F.lit(score))
        for kind, grades in _GRADED.items()
        for grade, score in grades.items()
    ]
    return _chain(cases)


def event_outcome() -> Column:
    return _chain([(_is(k), F.when(F.col("flag"), ok).otherwise(bad)) for k, (ok, bad) in _OUTCOMES.items()])


def _chain(cases: list[tuple[Column, Column]]) -> Column:
    (first, value), *rest = cases
    out = F.when(first, value)
    for condition, then in rest:
        out = out.when(condition, then)
    return out


def flatten_events(df: DataFrame) -> DataFrame:
    """One shape for the five event kinds: who, what, where, plus a metadata map."""
    pick = lambda key: F.try_element_at(F.col("details"), F.lit(key))
    pair = lambda name, kind, value: F.struct(
        F.lit(name).alias("k"), F.when(_is(kind), value).cast("string").alias("v")
    )
    own = F.filter(
        F.array(
            pair("auth_method", "authentication", F.col("method")),
            pair("ip_address", "authentication", F.col("ip_address")),
            pair("action", "authorization", F.col("action")),
            pair("operation", "data_access", F.col("action")),
            pair("classification", "data_access", F.col("grade")),
            pair("threat_type", "threat_detected", F.col("threat_type")),
            pair("policy", "policy_violation", F.col("policy")),
            pair("violation_type", "policy_violation", F.col("violation_type")),
        ),
        lambda e: e["v"].isNotNull(),
    )
    nothing = F.create_map().cast("map<string,string>")
    extra = F.when(_is("threat_detected"), F.coalesce(F.col("details"), nothing)).otherwise(nothing)
    # details win over the event's own keys, as later inserts do
    kept = F.filter(own, lambda e: ~F.map_contains_key(extra, e["k"]))
    threat = _is("threat_detected")
    return df.select(
        "id",
        "event_type",
        "user_id",
        F.when(_is("authorization") | _is("data_access"), F.col("resource")).alias("resource"),
        F.when(_is("authorization") | _is("data_access"), F.col("action"))
        .when(_is("policy_violation"), F.col("violation_type"))
        .alias("action"),
        F.when(_is("authentication"), F.col("ip_address")).when(threat, pick("ip_address")).alias("ip_address"),
        F.when(threat, pick("user_agent")).alias("user_agent"),
        F.when(threat, pick("session_id")).alias("session_id"),
        F.when(threat, pick("tenant_id")).alias("tenant_id"),
        F.map_concat(F.map_from_entries(kept), extra).alias("metadata"),
    )
