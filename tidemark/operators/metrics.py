"""Benchmark statistics, token cost, counters and health figures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.fixed_values import MODEL_PRICES
from tidemark.session import cut_lineage

# --------------------------------------------------------------- benchmarks

SPLITS, ACCURACY = 256, 10_000  # splitters taken from a quantile sketch, and the sketch's 1 / rank error


def same_keys(keys: Sequence[str], prefix: str) -> Column:
    """Null-safe equality of ``keys`` with columns of these names behind ``prefix``."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(prefix + k))
    return same


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column], also: Sequence[Column] = ()) -> DataFrame:
    """The elements at given 0-based ranks of each group's sorted values, with ``n`` and the aggregates ``also``.

    Two scans. The first makes a mergeable quantile sketch of every group; its splitters bound, with the sketch's
    error on both sides, the values that an asked rank can have, whatever the spread of the values. The second
    counts what lies below a rank's range and keeps, counted by value, only what lies inside; at most about
    three in ``SPLITS`` of a group's rows and their equals are then put in order. ``ranks`` maps an output name to
    a rank expression over ``n``. Groups without values have no row.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull())
    shares = [i / SPLITS for i in range(SPLITS + 1)]
    sketched = cut_lineage(known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx(value, shares, ACCURACY).alias("_splits"), *also))
    slack = 2.0 / ACCURACY

    def bound(at: Column) -> Column:
        return F.when((at >= 0) & (at <= SPLITS), F.try_element_at("_splits", (at + 1).cast("int")))

    bounds = []
    for i, rank in enumerate(ranks.values()):
        rank = rank.cast("bigint")
        low = F.floor((rank / F.col("n") - slack) * SPLITS)
        high = F.ceil(((rank + 1) / F.col("n") + slack) * SPLITS)
        bounds += [rank.alias(f"_rank{i}"), bound(low).alias(f"_low{i}"), bound(high).alias(f"_high{i}")]
    wanted = sketched.select(*[F.col(k).alias("_of_" + k) for k in keys], *bounds)
    rows = known.select(*keys, F.col(value).alias("_v")).join(wanted, same_keys(keys, "_of_"))
    under = [F.coalesce(F.col("_v") < F.col(f"_low{i}"), F.lit(False)) for i in range(len(ranks))]
    within = [~u & F.coalesce(F.col("_v") <= F.col(f"_high{i}"), F.lit(True)) for i, u in enumerate(under)]
    # what lies in no range only counts: it has no value from here on
    counted = rows.groupBy(*keys, F.when(reduce(or_, within), F.col("_v")).alias("_w"), *[f"_{c}{i}" for i in range(len(ranks)) for c in ("rank", "low", "high")]).agg(
        F.count(F.lit(1)).alias("_c"), *[F.count_if(u).alias(f"_under{i}") for i, u in enumerate(under)])
    here = [(F.col("_w") >= F.coalesce(f"_low{i}", "_w")) & (F.col("_w") <= F.coalesce(f"_high{i}", "_w")) for i in range(len(ranks))]
    placed = F.array(*[F.struct(
        F.lit(name).alias("name"), F.col(f"_rank{i}").alias("rank"), F.when(here[i], F.col("_w")).alias("v"),
        F.when(here[i], F.col("_c")).otherwise(F.col(f"_under{i}")).alias("c")) for i, name in enumerate(ranks)])
    each = counted.select(*keys, F.explode(placed).alias("_p")).select(
        *keys, F.col("_p.name").alias("_name"), F.col("_p.rank").alias("_rank"), F.col("_p.v").alias("_v"), F.col("_p.c").alias("_c")).filter("_c > 0")
    upto = Window.partitionBy(*keys, "_name").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    reached = each.withColumn("_upto", F.sum("_c").over(upto)).filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
    found = reached.groupBy(*[F.col(k).alias("_of_" + k) for k in keys]).agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks])
    return sketched.drop("_splits").join(found, same_keys(keys, "_of_")).drop(*["_of_" + k for k in keys])


def benchmark_stats(df: DataFrame, keys: Sequence[str] = ("operation",), value: str = "duration_ms") -> DataFrame:
    """n, total, mean, median, sample deviation, min, max, p95 and p99 per group.

    The median averages the middle pair; p95 and p99 are the sorted elements at
    ``floor(n * p)``, counted from 0.
    """
    n = F.col("n")
    ranks = {
        "_low": F.floor((n - 1) / 2),
        "_high": F.floor(n / 2),
        "p95": F.floor(n * 0.95),
        "p99": F.floor(n * 0.99),
    }
    moments = [
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("stdev"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]
    found = order_statistics(df, keys, value, ranks, moments)
    return found.select(
        *keys, n.alias("iterations"), "total", "mean", "stdev", "min", "max", "p95", "p99", ((F.col("_low") + F.col("_high")) / 2).alias("median"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pair two result sets ``(operation, mean_ms, skipped, error)``: status and factor a / b."""
    left = a.select("operation", F.col("mean_ms").alias("a_mean"), F.col("skipped").alias("a_skip"), F.col("error").alias("a_err"))
    right = b.select("operation", F.col("mean_ms").alias("b_mean"), F.col("skipped").alias("b_skip"), F.col("error").alias("b_err"))
    both = left.join(right, "operation", "full_outer")
    skipped = F.coalesce("a_skip", F.lit(False)) | F.coalesce("b_skip", F.lit(False))
    failed = F.col("a_err").isNotNull() | F.col("b_err").isNotNull()
    known = (F.coalesce("a_mean", F.lit(0.0)) > 0) & (F.coalesce("b_mean", F.lit(0.0)) > 0)
    status = F.when(skipped, "skipped").when(failed, "error").when(known, "compared").otherwise("missing")
    return both.withColumn("status", status).select(
        "operation", "a_mean", "b_mean", "status",
        F.when(F.col("status") == "compared", F.col("a_mean") / F.col("b_mean")).alias("speedup"),
    )


def mean_speedup(compared: DataFrame) -> DataFrame:
    return compared.agg(F.avg("speedup").alias("mean_speedup"), F.count("speedup").alias("compared"))


def performance_gains(df: DataFrame, ours: str = "ours", other: str = "other") -> DataFrame:
    """Gains over the other side; columns ``<side>_time, _memory, _cpu, _throughput, _errors``."""
    o = lambda name: F.col(f"{ours}_{name}").cast("double")
    c = lambda name: F.col(f"{other}_{name}").cast("double")
    gain = lambda name: F.greatest(F.try_divide(c(name) - o(name), c(name)) * 100.0, F.lit(0.0))
    return df.select(
        "*",
        gain("time").alias("speed_improvement_percent"),
        gain("memory").alias("memory_reduction_percent"),
        gain("cpu").alias("cpu_efficiency_gain"),
        F.try_divide(o("throughput"), c("throughput")).alias("throughput_multiplier"),
        F.greatest(c("errors") - o("errors"), F.lit(0.0)).alias("reliability_improvement"),
    )


# ------------------------------------------------------------ tokens, money


def model_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODEL_PRICES, "model string, provider string, input_price double, output_price double")


def token_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls with provider and cost; models without a price get a null cost."""
    cost = F.col("prompt_tokens") * F.col("input_price") + F.col("completion_tokens") * F.col("output_price")
    return calls.join(prices, "model", "left").withColumn("cost", cost).drop("input_price", "output_price")


def cost_totals(costed: DataFrame) -> DataFrame:
    """Totals per model, per provider and over all, as grouping sets."""
    provider, model = F.col("provider"), F.col("model")
    return costed.groupingSets([[provider, model], [provider], []], provider, model).agg(F.grouping_id("provider", "model").cast("int").alias("level"), F.count("*").alias("calls"), F.sum("cost").alias("cost"))


def token_usage(calls: DataFrame) -> DataFrame:
    """Tokens by every combination of model and finish reason."""
    return calls.cube("model", "finish_reason").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("calls"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
    )


# ----------------------------------------------------------------- counters

KINDS = ("workflow", "tool", "model", "memory")


def duration_totals(df: DataFrame, kind: str = "kind", duration: str = "duration_ms") -> DataFrame:
    """One row: summed time of each kind and the number of operations."""
    sums = [F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(duration))), F.lit(0)).alias(f"total_{k}_time") for k in KINDS]
    counts = [F.count_if(F.col(kind) == k).alias(f"{k}_operations") for k in KINDS]
    return df.agg(*sums, *counts)


def metric_counters(df: DataFrame, kind: str = "kind") -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("events"))


# ------------------------------------------------------------------- health


def _has_issue(levels: Sequence[str]) -> Column:
    return F.exists("issues", lambda s: s.isin(list(levels)))


def build_health(modules: DataFrame, min_coverage: float = 80.0) -> DataFrame:
    """Four all-modules checks of 25 points each; nothing passes without modules.

    ``modules(module, status, tests_failed, coverage, issues)``, status one of
    clean, warnings, errors; issues an array of severities.
    """
    some = F.count("*") > 0
    checks = {
        "build_passing": F.bool_and(F.col("status").isin("clean", "warnings")),
        "all_tests_passing": F.bool_and(F.col("tests_failed") == 0),
        "coverage_threshold_met": F.bool_and(F.col("coverage") >= min_coverage),
        "no_critical_issues": F.bool_and(~_has_issue(["Critical"])),
    }
    flags = modules.agg(*[(some & F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    score = sum((F.col(n).cast("int") for n in checks), F.lit(0)) * 25.0
    return flags.withColumn("overall_score", score)


def problem_modules(modules: DataFrame, min_coverage: float = 80.0) -> DataFrame:
    return modules.filter(
        (F.col("status") == "errors")
        | (F.col("tests_failed") > 0)
        | (F.col("coverage") < min_coverage)
        | _has_issue(["Critical", "High"])
    )


def availability(features: DataFrame) -> DataFrame:
    """Available and total per category, the overall row under a null category; percent 0 when empty."""
    return features.rollup("category").agg(
        F.grouping("category").cast("int").alias("is_total"),
        F.count_if("available").alias("available"),
        F.count("*").alias("total"),
        F.when(F.count("*") == 0, 0.0).otherwise(F.count_if("available") * 100.0 / F.count("*")).alias("percent"),
    )


def missing_features(features: DataFrame) -> DataFrame:
    return features.filter(~F.col("available"))
