"""Templates, routing, column chains, model calls and merged results."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import first_n
from tidemark.operators.validation import has_unsafe_pattern

# ---------------------------------------------------------------- templates


def substitute(template: Column, variables: Column) -> Column:
    """``{name}`` from a map; odd names, unknown names and unsafe values stay as they are."""
    names = F.regexp_extract_all(template, F.lit(r"\{([^{}]+)\}"), F.lit(1))

    def put(acc: Column, name: Column) -> Column:
        value = F.try_element_at(variables, name)
        usable = (
            name.rlike(r"^[\p{IsAlphabetic}\p{N}_.]+$") & ~name.contains("..")
            & value.isNotNull() & ~has_unsafe_pattern(value)
        )
        return F.when(usable, F.replace(acc, F.concat(F.lit("{"), name, F.lit("}")), value)).otherwise(acc)

    return F.aggregate(names, template, put)


def render_prompt(template: Column, variables: Column) -> Column:
    """``{{name}}`` from a map, keys in order, no guards."""
    return F.aggregate(
        F.array_sort(F.map_entries(variables)),
        template,
        lambda acc, e: F.replace(acc, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))),
    )


def template_vars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\{\{([^{}]+)\}\}"), F.lit(1))


def double_braces(text: Column) -> Column:
    return F.regexp_replace(text, r"\{([^{}]+)\}", "{{$1}}")


# -------------------------------------------------------------------- chains


def route(df: DataFrame, key: Column, branches: Mapping[str, Column], default: Column | None = None) -> DataFrame:
    """Add ``route``, ``output`` and ``route_error``: the branch named by the key, else the default, else an error.

    Branches are column expressions, so all of them share one pass.
    """
    name = key.cast("string")
    known = F.coalesce(name.isin(list(branches)), F.lit(False))
    output = default if default is not None else F.lit(None)
    for branch, column in branches.items():
        output = F.when(name == branch, column).otherwise(output)
    fallback = F.lit("default") if default is not None else F.lit(None)
    error = F.lit(None).cast("string")
    if default is None:
        error = F.when(~known, F.concat(F.lit("no route for key: "), F.coalesce(name, F.lit("null"))))
    return df.select(
        "*", F.when(known, name).otherwise(fallback).alias("route"), output.alias("output"), error.alias("route_error")
    )


def transform_chain(
    df: DataFrame, column: str, stages: Sequence[tuple[str, Callable[[Column], Column]]], halt_on_error: bool = True
) -> DataFrame:
    """Apply named stages in order to a column; a stage fails by giving null.

    Adds ``output`` and ``failed_stages``. When halting, the first failure ends
    the row with a null output; otherwise the stage is passed over.
    """
    start = F.struct(F.col(column).alias("v"), F.array().cast("array<string>").alias("failed"))
    out = df.withColumn("_s", start)
    for name, stage in stages:
        tried = stage(F.col("_s.v"))
        stopped = F.size("_s.failed") > 0 if halt_on_error else F.lit(False)
        ok = tried.isNotNull()
        value = F.when(stopped, F.col("_s.v")).when(ok, tried)
        if not halt_on_error:
            value = value.otherwise(F.col("_s.v"))
        failed = F.when(stopped | ok, F.col("_s.failed")).otherwise(F.concat("_s.failed", F.array(F.lit(name))))
        out = out.withColumn("_s", F.struct(value.alias("v"), failed.alias("failed")))
    return out.withColumn("output", F.col("_s.v")).withColumn("failed_stages", F.col("_s.failed")).drop("_s")


def stage_counts(chained: DataFrame, stages: Sequence[str], halt_on_error: bool = True) -> DataFrame:
    """(stage, succeeded, failed) over the rows that reached the stage."""
    failed = {s: F.array_contains("failed_stages", s) for s in stages}
    aggs = []
    for i, s in enumerate(stages):
        stopped = F.lit(False)
        if halt_on_error:
            for earlier in stages[:i]:
                stopped = stopped | failed[earlier]
        aggs += [F.count_if(~stopped & ~failed[s]).alias(f"ok{i}"), F.count_if(failed[s]).alias(f"bad{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("stage"), F.col(f"ok{i}").alias("succeeded"), F.col(f"bad{i}").alias("failed"))
            for i, s in enumerate(stages)
        ]
    )
    return chained.agg(*aggs).select(F.inline(rows))


def map_reduce(
    df: DataFrame, map_line: Callable[[Column], Column], reduce_lines: Callable[[Column], Column], text: str = "text", out: str = "output"
) -> DataFrame:
    """Split on newlines, drop empties, map each line, reduce the array of results.

    Everything happens inside the row: no explode, no shuffle. Lines whose
    mapping gives null have no result.
    """
    lines = F.filter(F.split(F.col(text), "\n"), lambda v: v != "")
    return df.withColumn(out, reduce_lines(F.filter(F.transform(lines, map_line), lambda v: v.isNotNull())))


# --------------------------------------------------------------- model calls

RESPONSE = "struct<content:string,prompt_tokens:bigint,completion_tokens:bigint,finish_reason:string>"


def infer(
    df: DataFrame, model_fn: Callable[[list[str]], list[dict]], prompt: str = "prompt", out: str = "response", batch_size: int = 32
) -> DataFrame:
    """Add a response struct; the user's callable gets lists of prompts.

    It returns one mapping per prompt with content, prompt_tokens,
    completion_tokens and finish_reason; a raised error ends as finish_reason
    ``error`` for the batch, so that one bad call does not end the job.
    """

    @F.pandas_udf(RESPONSE)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            values, answers = prompts.fillna("").tolist(), []
            for i in range(0, len(values), batch_size):
                part = values[i : i + batch_size]
                try:
                    answers += list(model_fn(part))
                except Exception as e:  # noqa: BLE001
                    answers += [{"content": str(e), "prompt_tokens": 0, "completion_tokens": 0, "finish_reason": "error"}] * len(part)
            yield pd.DataFrame(answers, columns=["content", "prompt_tokens", "completion_tokens", "finish_reason"])

    return df.withColumn(out, call(F.col(prompt)))


# ------------------------------------------------------------- merged results

SHAPE = ["title", "link", "snippet", "source"]


def merge_results(*results: DataFrame, cap: int | None = None, order: str = "position") -> DataFrame:
    """Result tables of several providers in one shape, at most ``cap`` rows per source."""
    merged = reduce(DataFrame.unionByName, [r.select(*SHAPE, order) for r in results])
    if cap is None:
        return merged
    return first_n(merged, ["source"], [F.col(order), F.col("link")], cap, "_n").drop("_n")
