"""Order-dependent building blocks that never put an unbounded group in memory.

* ``split_by_time``      cuts a key's history into time slices, so that a key
                         owning a third of all rows is spread over many tasks.
* ``position_in_order``  exact row positions from bucket counts plus a rank
                         inside each bucket; no global or per-key sort.
* ``newest``             the newest *n* rows, ranking only the boundary bucket.
* ``ordered_fold``       left fold per key, streamed over sorted batches with
                         carried state, so memory stays O(state).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since the epoch for a timestamp of either kind."""
    return F.unix_micros(ts.cast("timestamp"))


def moment(value: dt.datetime | Column) -> Column:
    """A literal that no machine's zone can shift; naive times stay zone-less and prune zone-less columns."""
    if isinstance(value, Column):
        return value
    kind = "timestamp" if value.tzinfo else "timestamp_ntz"
    return F.lit(value.isoformat(sep=" ")).cast(kind)


def split_by_time(df: DataFrame, at: Column, reach: int, slice_len: int | None = None) -> DataFrame:
    """Add ``_slice`` and ``_context``.

    Every row sits in its own slice; rows closer than ``reach`` to the slice's
    end are also handed to the next one as context, so that a look-back of up
    to ``reach`` can be answered inside (key, slice) alone.
    """
    length = max(slice_len or reach, reach)
    own = F.floor(at / F.lit(length)).cast("bigint")
    with_at = df.withColumn("_at", at).withColumn("_own", own)
    both = F.when(
        (F.col("_own") + 1) * F.lit(length) - F.col("_at") <= F.lit(reach),
        F.array(F.col("_own"), F.col("_own") + 1),
    ).otherwise(F.array(F.col("_own")))
    return (
        with_at.withColumn("_slice", F.explode(both))
        .withColumn("_context", F.col("_slice") != F.col("_own"))
        .drop("_own")
    )


def position_in_order(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column | str], out: str
) -> DataFrame:
    """0-based position of each row within ``keys`` ordered by (bucket, order).

    ``bucket`` must be monotone in the wanted order. Only bucket counts cross
    the window over ``keys``; rows are ranked inside (keys, bucket).
    """
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    named = [F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]
    offsets = counts.select(
        *named, F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = tagged.withColumn("_rank", F.row_number().over(inside))
    same = F.col("_bucket").eqNullSafe(F.col("_of"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    return (
        ranked.join(offsets, same)
        .withColumn(out, (F.col("_before") + F.col("_rank") - 1).cast("bigint"))
        .drop("_bucket", "_rank", "_before", "_of", *[f"_key_{i}" for i in range(len(keys))])
    )


def newest(df: DataFrame, at: Column, tie: str, n: int, slice_len: int = 60 * MICROS) -> DataFrame:
    """The ``n`` newest rows by (at desc, tie desc)."""
    if n <= 0:
        return df.limit(0)
    tagged = df.withColumn("_at", at).withColumn("_bucket", F.floor(F.col("_at") / F.lit(slice_len)))
    # one row per time slice: small enough for a single ordered pass
    counts = tagged.groupBy("_bucket").agg(F.count("*").alias("_n"))
    newer = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0))).filter(
        F.col("_newer") < n
    )
    kept = tagged.join(offsets, "_bucket")
    whole = kept.filter(F.col("_newer") + F.col("_n") <= n)
    edge = kept.filter(F.col("_newer") + F.col("_n") > n)
    order = Window.partitionBy("_bucket").orderBy(F.desc("_at"), F.desc(tie))
    edge = edge.withColumn("_rank", F.row_number().over(order)).filter(
        F.col("_newer") + F.col("_rank") <= n
    )
    return whole.drop("_bucket", "_at", "_n", "_newer").unionByName(
        edge.drop("_bucket", "_at", "_n", "_newer", "_rank")
    )


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    reads: Sequence[str],
    start: Callable[[], object],
    step: Callable[..., tuple[object, Sequence[list] | None]],
    schema: str,
    finish: Callable[[object], tuple] | None = None,
) -> DataFrame:
    """Fold each key's rows in order; ``step(state, *lists)`` sees the columns ``reads`` of one stretch of a key.

    Columns of ``schema`` that ``df`` has are carried along; the others, in their order, are the lists that ``step``
    returns for its rows. With ``finish`` a key gives one row instead: the key and the values that it returns.

    Rows are hash partitioned by key and sorted by Spark (which spills), then
    streamed: the Python side holds one Arrow batch and one state, and hands on
    one batch for each that it gets, however many keys lie in it. A null key
    is a key like any other. Keys travel as text, so a nullable number keeps
    all its digits, and get their type back afterwards.
    """
    keys, order, reads = list(keys), list(order), list(reads)
    declared = T.StructType.fromDDL(schema)
    as_text = T.StructType([T.StructField(f.name, T.StringType() if f.name in keys else f.dataType) for f in declared])
    sorted_rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    rows_in = sorted_rows.select(*[F.col(c).cast("string").alias(c) if c in keys else F.col(c) for c in df.columns])
    own = keys if finish else df.columns
    made = [f.name for f in declared if f.name not in own]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = to_arrow_schema(as_text)

        def ready(carried: dict, lists: Sequence[list]):
            columns = carried | dict(zip(made, lists))
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds.field(n).type) for n in kinds.names for c in [columns[n]]], kinds.names)

        def ended(rows: list):
            return ready(dict(zip(keys, zip(*(key for key, _ in rows)))), list(zip(*(values for _, values in rows))))

        current, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            of = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            begins = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1])]
            given, out, done = [batch.column(c).to_pylist() for c in reads], [[] for _ in made], []
            for a, b in zip(begins, [*begins[1:], len(of)]):
                if of[a] != current:
                    if current is not None and finish:
                        done.append((current, finish(state)))
                    current, state = of[a], start()
                state, lists = step(state, *(g[a:b] for g in given))
                if lists is not None:
                    for whole, part in zip(out, lists):
                        whole += part
            if finish is None:
                yield ready({n: batch.column(n) for n in kinds.names if n not in made}, out)
            elif done:
                yield ended(done)
        if current is not None and finish:
            yield ended([(current, finish(state))])

    out = rows_in.mapInArrow(run, as_text)
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in declared])


GROUP_LIMIT = 1000  # up to this Spark itself prunes each task to the first n per group


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key in order, numbered from 1.

    Every task keeps at most ``n`` rows per key before the shuffle. Above
    Spark's own pruning threshold the group is first ranked in salted parts,
    each of which contains its share of the final rows.
    """
    if n <= 0:
        return df.withColumn(rank, F.lit(0)).limit(0)
    if n > GROUP_LIMIT:
        salt = F.pmod(F.xxhash64(*_hashable(df)), F.lit(64))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_r", F.row_number().over(part))
            .filter(F.col("_r") <= n)
            .drop("_salt", "_r")
        )
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= n)


def _hashable(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
