"""Cron schedules as array columns, and their firing times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.fixed_values import NAMED_SCHEDULES
from tidemark.operators.ordering import moment

BOUNDS = {
    "second": (0, 59), "minute": (0, 59), "hour": (0, 23), "day_of_month": (1, 31), "month": (1, 12), "day_of_week": (0, 7),
}


def parse_field(field: Column, low: int, high: int) -> Column:
    """Values of ``*``, ``n``, ``a-b``, ``a,b,c``, ``*/s``, ``n/s`` or ``a-b/s``; null when invalid.

    Bounds hold for every form, a step must be positive, a list holds numbers only.
    """
    number = lambda c: c.try_cast("int")
    base = F.split_part(field, F.lit("/"), F.lit(1))
    step = F.when(field.contains("/"), number(F.split_part(field, F.lit("/"), F.lit(2)))).otherwise(1)
    first = F.when(base == "*", F.lit(low)).otherwise(number(F.split_part(base, F.lit("-"), F.lit(1))))
    last = (
        F.when((base == "*") | (~base.contains("-") & field.contains("/")), F.lit(high))
        .when(base.contains("-"), number(F.split_part(base, F.lit("-"), F.lit(2))))
        .otherwise(first)
    )
    spans = field.rlike(r"^(\*|0*\d{1,4}|0*\d{1,4}-0*\d{1,4})(/0*\d{1,4})?$") & first.between(low, high) & last.between(first, high) & (step > 0)
    listed = F.transform(F.split(field, ","), number)
    is_list = field.rlike(r"^0*\d{1,4}(,0*\d{1,4})+$") & F.forall(listed, lambda v: v.between(low, high))
    return F.when(spans, F.sequence(first, last, step)).when(is_list, F.array_sort(F.array_distinct(listed)))


def parse_schedules(df: DataFrame, expression: str = "expression") -> DataFrame:
    """One array column per field, and ``error`` (null when the expression is valid)."""
    text = F.trim(F.col(expression))
    named = F.create_map(*[F.lit(v) for pair in NAMED_SCHEDULES.items() for v in pair])
    split = df.withColumn("_p", F.split(F.coalesce(F.try_element_at(named, text), text), r"\s+"))
    # seconds come first when there are six fields
    fields = F.when(F.size("_p") == 5, F.concat(F.array(F.lit("0")), "_p")).when(F.size("_p") == 6, F.col("_p"))
    limits = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in BOUNDS.values()])
    pairs = F.arrays_zip(fields.alias("text"), limits.alias("limit"))
    # inside the lambda every part is bound once, which keeps the plan small
    parsed = F.transform(pairs, lambda f: parse_field(f["text"], f["limit"]["lo"], f["limit"]["hi"]))
    named_columns = [F.get("_f", F.lit(i)).alias(name) for i, name in enumerate(BOUNDS)]
    out = split.withColumn("_t", fields).withColumn("_f", parsed).select(
        *df.columns,
        (F.get("_t", F.lit(3)) != "*").alias("_dom_set"),
        (F.get("_t", F.lit(5)) != "*").alias("_dow_set"),
        F.col("_t").isNull().alias("_unsized"),
        *named_columns,
    ).withColumn("day_of_week", F.array_distinct(F.transform("day_of_week", lambda d: d % 7)))
    unknown = text.startswith("@") & ~F.map_contains_key(named, text)
    error = F.when(unknown, "unknown name").when(F.col("_unsized"), "expected 5 or 6 fields")
    for name in BOUNDS:
        error = error.when(F.col(name).isNull(), f"invalid {name}")
    return out.withColumn("error", error).drop("_unsized")


def expand_schedules(df: DataFrame, start, end, expression: str = "expression", either_day: bool = False) -> DataFrame:
    """Firing times ``fire_at`` in ``[start, end)`` of the valid schedules.

    Days are tested first, then only the listed hours, minutes and seconds are
    built. All fields must hold; with ``either_day`` a schedule that limits
    both day fields fires when either holds.
    """
    parsed = parse_schedules(df, expression).filter(F.col("error").isNull())
    days = parsed.withColumn("_day", F.explode(F.sequence(F.to_date(moment(start)), F.to_date(moment(end)))))
    dom = F.array_contains("day_of_month", F.dayofmonth("_day"))
    dow = F.array_contains("day_of_week", F.dayofweek("_day") - 1)
    day_ok = dom & dow
    if either_day:
        day_ok = F.when(F.col("_dom_set") & F.col("_dow_set"), dom | dow).otherwise(day_ok)
    days = days.filter(F.array_contains("month", F.month("_day")) & day_ok)
    timed = (
        days.withColumn("_h", F.explode("hour")).withColumn("_m", F.explode("minute")).withColumn("_s", F.explode("second"))
    )
    offset = F.make_dt_interval(F.lit(0), F.col("_h"), F.col("_m"), F.col("_s").cast("decimal(18,6)"))
    at = F.col("_day").cast("timestamp_ntz") + offset
    keep = [c for c in df.columns]
    return timed.select(*keep, at.alias("fire_at")).filter((F.col("fire_at") >= moment(start)) & (F.col("fire_at") < moment(end)))


def apply_window(df: DataFrame, at: str = "fire_at", opens: int = 9, closes: int = 17) -> DataFrame:
    """Firings inside their ``HH:MM`` window (which may pass midnight) and, if asked, business hours.

    ``df(fire_at, window_start, window_end, business_hours_only)``; null bounds
    leave that side open. Business hours are Monday to Friday, ``[opens, closes)``.
    """
    clock = F.date_format(at, "HH:mm")
    lo, hi = F.coalesce("window_start", F.lit("00:00")), F.coalesce("window_end", F.lit("23:59"))
    inside = F.when(lo <= hi, clock.between(lo, hi)).otherwise((clock >= lo) | (clock <= hi))
    working = F.weekday(at).between(0, 4) & F.hour(at).between(opens, closes - 1)
    return df.filter(inside & (~F.coalesce("business_hours_only", F.lit(False)) | working))


def retry_times(df: DataFrame, at: str = "fire_at") -> DataFrame:
    """One row per retry: fixed backoff waits the same time, exponential doubles it.

    ``df(fire_at, max_attempts, backoff_minutes, exponential)``.
    """
    attempts = F.when(F.col("max_attempts") > 0, F.sequence(F.lit(1), F.col("max_attempts"))).otherwise(F.array().cast("array<int>"))
    waited = F.when(F.col("exponential"), F.pow(F.lit(2), F.col("attempt")) - 1).otherwise(F.col("attempt"))
    minutes = (waited * F.col("backoff_minutes")).cast("int")
    return df.withColumn("attempt", F.explode(attempts)).withColumn(
        "retry_at", F.col(at) + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    )
