"""Checks and status rules over tables of workflow definitions and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.fixed_values import RISKY_COMMAND_TEXT, SAFE_URL_TEXT, SYSTEM_PATHS, UNDELETABLE_PATHS
from tidemark.operators.graphs import LEVEL, UNBLOCKED, WHOLE, solve

STEP = ["workflow_id", "step_id"]


def dependencies(steps: DataFrame) -> DataFrame:
    """Edges (workflow_id, step_id, depends_on) of the dependency graph."""
    return steps.select(*STEP, F.explode("depends_on").alias("depends_on")).distinct()


def missing_dependencies(steps: DataFrame) -> DataFrame:
    present = steps.select("workflow_id", F.col("step_id").alias("depends_on"))
    return dependencies(steps).join(present, ["workflow_id", "depends_on"], "left_anti").select(*STEP, "depends_on")


def duplicate_steps(steps: DataFrame) -> DataFrame:
    return steps.groupBy(*STEP).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def dag_levels(steps: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(workflow_id, step_id, level) for many workflows at once.

    A step without dependencies has level 0, any other one more than its highest dependency. Cycles, missing
    dependencies and whatever hangs on them have a null level. Workflows are packed into tasks after one shuffle;
    one of more than ``whole`` steps and dependencies is solved by joins, see ``graphs``.
    """
    deps = F.coalesce("depends_on", F.array().cast(dict(steps.dtypes)["depends_on"]))
    alone = F.array(F.lit(None).cast(dict(steps.dtypes)["step_id"]))
    rows = steps.select(F.col("workflow_id").alias("graph"), F.col("step_id").alias("node"), F.explode(F.concat(alone, F.array_compact(deps))).alias("parent"))
    return solve(rows, LEVEL, whole).select(F.col("graph").alias("workflow_id"), F.col("node").alias("step_id"), F.col("value").alias("level"))


def propagate_status(steps: DataFrame, results: DataFrame, whole: int = WHOLE) -> DataFrame:
    """(workflow_id, step_id, status) after skipping.

    A step is Skipped when a direct dependency ends Failed, unless it continues
    on error; a Skipped dependency does not block. A step without a result keeps a
    null status unless it is Skipped. Only failed steps can pass
    anything on, so only edges between failed steps are solved.
    """
    own = steps.select(*STEP, "depends_on", F.coalesce("continue_on_error", F.lit(False)).alias("continues"))
    own = own.join(results.select(*STEP, "status"), STEP, "left")
    edges = own.filter(~F.col("continues")).select(*STEP, F.explode("depends_on").alias("parent")).distinct()
    failed = own.filter(F.col("status") == "Failed").select(*STEP)
    to_failed = edges.join(failed.select("workflow_id", F.col("step_id").alias("parent")), ["workflow_id", "parent"])
    inner = to_failed.join(failed, STEP, "left_semi").select(*STEP, "parent")
    rows = failed.withColumn("parent", F.lit(None).cast(dict(steps.dtypes)["step_id"])).unionByName(inner)
    ends = solve(rows.select(F.col("workflow_id").alias("graph"), F.col("step_id").alias("node"), "parent"), UNBLOCKED, whole)
    blockers = ends.filter("value = 1").select(F.col("graph").alias("workflow_id"), F.col("node").alias("parent"))
    skipped = to_failed.join(blockers, ["workflow_id", "parent"], "left_semi").select(*STEP).distinct().withColumn("skipped", F.lit(True))
    return own.join(skipped, STEP, "left").select(
        *STEP, F.when(F.col("skipped"), "Skipped").otherwise(F.col("status")).alias("status")
    )


def workflow_status(results: DataFrame) -> DataFrame:
    status = F.col("status")
    return results.groupBy("workflow_id").agg(
        F.when(F.bool_or(status == "Failed"), "Failed")
        .when(F.bool_and(status == "Skipped"), "Cancelled")
        .otherwise("Completed")
        .alias("status"),
        F.count("*").alias("steps"),
        F.sum("duration_ms").alias("total_duration_ms"),
    )


# ------------------------------------------------------------------ safety


def _contains_any(text: Column, words) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return F.coalesce(hit, F.lit(False))


def _starts_with_any(text: Column, prefixes) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | text.startswith(prefix)
    return F.coalesce(hit, F.lit(False))


def url_is_safe(url: Column) -> Column:
    """Private-looking addresses and https are safe, everything else is not."""
    return _contains_any(url, SAFE_URL_TEXT) | F.coalesce(url.startswith("https://"), F.lit(False))


# Fixed values: (rule, step types it applies to, contribution, severity); each counts once per workflow.
_WORKFLOW_RULES = [
    ("no_rm_rf", ["command"], 100, "Critical"),
    ("no_sudo", ["command"], 100, "Critical"),
    ("no_system_paths", ["create_file", "edit_file", "delete_file"], 100, "Critical"),
    ("timeout_required", ["*"], 10, "Warning"),
]
_SAFE_BELOW = {"permissive": 80, "standard": 50, "strict": 20}


def safety_risk(steps: DataFrame, mode: str = "standard") -> DataFrame:
    """(workflow_id, steps, issues, critical_issues, risk_score, is_safe).

    ``steps(workflow_id, step_id, step_type, command, path, url,
    timeout_seconds)``. Workflow rules count once however many steps break
    them, step rules count each time; one aggregation with map-side partials.
    """
    if mode not in _SAFE_BELOW:
        raise ValueError(f"unknown mode: {mode}")
    kind = F.col("step_type")
    broken = {
        "no_rm_rf": _contains_any(F.col("command"), ["rm -rf", "rm -r"]),
        "no_sudo": _contains_any(F.col("command"), ["sudo"]),
        "no_system_paths": _starts_with_any(F.col("path"), SYSTEM_PATHS),
        "timeout_required": F.col("timeout_seconds").isNull(),
    }
    each_step = [
        ("Critical", 30, (kind == "Command") & _contains_any(F.lower("command"), RISKY_COMMAND_TEXT)),
        ("Critical", 50, (kind == "DeleteFile") & _starts_with_any(F.col("path"), UNDELETABLE_PATHS)),
        ("Warning", 15, (kind == "Http") & F.col("url").isNotNull() & ~url_is_safe(F.col("url"))),
    ]
    if mode == "strict":
        each_step.append(("Info", 5, F.col("timeout_seconds").isNull()))

    aggs, names = [F.count("*").alias("steps")], []
    for rule, applies, points, severity in _WORKFLOW_RULES:
        fires = F.bool_or(broken[rule])
        if applies != ["*"]:
            fires = fires & F.bool_or(F.lower(kind).isin(applies))
        aggs.append(fires.cast("int").alias(rule))
        names.append((rule, points, severity))
    for i, (severity, points, hit) in enumerate(each_step):
        aggs.append(F.count_if(hit).alias(f"step_rule_{i}"))
        names.append((f"step_rule_{i}", points, severity))

    total = lambda weight: sum((F.col(n) * weight(p, s) for n, p, s in names), F.lit(0))
    risk = total(lambda p, s: p)
    critical = total(lambda p, s: int(s == "Critical"))
    safe = risk < _SAFE_BELOW[mode]
    if mode == "strict":
        safe = safe & (critical == 0)
    return steps.groupBy("workflow_id").agg(*aggs).select(
        "workflow_id",
        "steps",
        total(lambda p, s: 1).cast("bigint").alias("issues"),
        critical.cast("bigint").alias("critical_issues"),
        risk.cast("bigint").alias("risk_score"),
        safe.alias("is_safe"),
    )
