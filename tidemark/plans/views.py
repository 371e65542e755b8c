"""Views of the shared tables that several plans start from, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_STAMP = "%Y-%m-%d %H:%M:%S.%f"


def stamp(column: str):
    return F.date_format(column, STAMP)


_AUDIT_SELECT = """
    event_id AS id, ts AS timestamp, user_id,
    CASE event_type WHEN 'click' THEN 'UserAction' WHEN 'view' THEN 'DataAccess'
        WHEN 'purchase' THEN 'ToolExecution' WHEN 'signup' THEN 'Authentication'
        ELSE 'SystemError' END AS event_type,
    'user_' || CAST(user_id AS {text}) AS actor,
    'res_' || CAST(event_id % 20 AS {text}) AS resource,
    event_type AS action,
    CASE WHEN event_type = 'error' THEN 'Failure' WHEN value > 200 THEN 'Blocked'
        ELSE 'Success' END AS outcome,
    CASE WHEN value < 20 THEN 'Low' WHEN value < 60 THEN 'Medium'
        WHEN value < 120 THEN 'High' ELSE 'Critical' END AS risk_level,
    value AS execution_time_ms,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 512 END AS memory_usage_mb,
    CASE WHEN event_id % 7 = 0 THEN NULL
        ELSE 'sess_' || CAST(user_id AS {text}) || '_' || CAST(event_id % 4 AS {text}) END AS session_id,
    'mission_' || CAST(event_id % 11 AS {text}) AS mission_id,
    'corr_' || CAST(event_id % 13 AS {text}) AS correlation_id,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'tool_' || CAST(event_id % 6 AS {text}) END AS tool_name
"""

AUDIT_SQL = "SELECT " + _AUDIT_SELECT.format(text="VARCHAR") + ", props FROM events"


def audit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit entries derived from ``events``; ``details`` holds the parsed props."""
    return audit_entries(table(spark, sf_dir, "events"))


def audit_entries(events: DataFrame) -> DataFrame:
    entries = events.selectExpr(
        *_split(_AUDIT_SELECT.format(text="STRING")), "props"
    )
    return entries.withColumn("details", F.from_json("props", "map<string,string>")).withColumn(
        "tags", F.array(F.concat(F.lit("t"), (F.col("id") % 3).cast("string")), F.col("action"))
    )


def _split(select: str) -> list[str]:
    """The select list as single expressions (commas inside brackets stay)."""
    parts, depth, current = [], 0, ""
    for ch in select:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += ch
    return [*parts, current.strip()]


_SECURITY_SELECT = """
    event_id AS id, ts AS timestamp,
    CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'user_' || CAST(user_id AS {text}) END AS user_id,
    CASE event_type WHEN 'click' THEN 'authorization' WHEN 'view' THEN 'data_access'
        WHEN 'purchase' THEN 'policy_violation' WHEN 'signup' THEN 'authentication'
        ELSE 'threat_detected' END AS event_type,
    'res_' || CAST(event_id % 20 AS {text}) AS resource,
    event_id % 3 <> 0 AS flag,
    CASE event_type
        WHEN 'view' THEN CASE event_id % 5 WHEN 0 THEN 'Public' WHEN 1 THEN 'Internal'
            WHEN 2 THEN 'Confidential' WHEN 3 THEN 'Restricted' ELSE 'TopSecret' END
        WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium'
            WHEN 2 THEN 'High' ELSE 'Critical' END
        WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'Minor' WHEN 1 THEN 'Major'
            ELSE 'Critical' END
        ELSE NULL END AS grade
"""

SECURITY_SQL = "SELECT " + _SECURITY_SELECT.format(text="VARCHAR") + ", user_id AS uid, value, props FROM events"


def security_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Security events as one wide table; ``flag`` is success or granted."""
    return table(spark, sf_dir, "events").selectExpr(
        *_split(_SECURITY_SELECT.format(text="STRING")), "user_id AS uid", "value", "props"
    )
