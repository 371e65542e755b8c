"""Exact deduplication by 128-bit content hash, with bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, replace_columns, stored, text_or_empty

RESULT = ["keep_id", "group_size", "kept", "text_sha256"]


def content_hash(text: Column) -> Column:
    """128 bits of the text's bytes."""
    return F.unhex(F.md5(text))


def exact_groups(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = ascii_lower,
    hash128: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """``docs`` with keep_id, group_size, kept and text_sha256 for every row.

    Texts are equal when their normalised bytes are. Grouping is by hash and bytes: rows that share only the
    hash form different groups. Copies meet in the task that reads them first, so a group of any size sends
    one row per task; only groups of two or more are stored, and joined back by hash (both sides of that join
    are plain exchanges, which adaptive execution may split for a hot group).

    Null text counts as empty. A null id never stays while its group has another id. Of rows repeated with
    the same id and text one is kept, the first in reading order. Input columns named like a result column
    are replaced. An empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    largest = keep == "largest"
    row = F.monotonically_increasing_id()
    base = replace_columns(docs, RESULT).withColumns({"__n": normalise(text_or_empty(text)), "__row": row})
    base = base.withColumns({"__h": hash128(F.col("__n")), "text_sha256": F.sha2(F.col("__n"), 256)})
    known = F.col(id).isNotNull()
    order = F.struct(known.alias("known") if largest else (~known).alias("missing"), F.col(id).alias("id"),
                     (-F.col("__row") if largest else F.col("__row")).alias("row"))
    groups = (
        base.groupBy("__h", "__n")
        .agg(F.count(F.lit(1)).alias("size"), (F.max if largest else F.min)(order).alias("first"))
        .where("size > 1")
        .select("__h", F.sha2("__n", 256).alias("text_sha256"), "size", F.col("first.id").alias("first_id"),
                F.abs("first.row").alias("first_row"))
    )
    groups = stored(groups, "exact-groups")
    return base.join(groups, ["__h", "text_sha256"], "left").select(
        *[F.col(c) for c in docs.columns if c.lower() not in RESULT],
        F.when(F.col("size").isNull(), F.col(id)).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first_row") == F.col("__row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: str = "smallest", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with their own columns."""
    marked = exact_groups(docs, id, text, keep, **options)
    missing = [c for c in docs.columns if c.lower() in RESULT]
    if missing:  # their own columns were replaced; take them aside first
        aside = docs.select(*[F.col(c).alias(f"__own_{c}") if c in missing else F.col(c) for c in docs.columns])
        marked = exact_groups(aside, id, text, keep, **options)
        return marked.where("kept").select(*[F.col(f"__own_{c}").alias(c) if c in missing else F.col(c) for c in docs.columns])
    return marked.where("kept").select(*docs.columns)
