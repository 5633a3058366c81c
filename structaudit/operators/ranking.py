"""Numbering rows inside groups of any size.

``row_number() <= k`` needs no help: Spark limits each group on the map side first. A full
numbering does, because a plain window sends a whole group to one task. Where groups can be large the
caller names slices: values that grow with the order. Rows are numbered inside their slice, and the
totals of the slices before, of which there is one row each, are added. It is one plan at any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every group, numbered from 1."""
    within = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(within)).where(F.col(rank) <= k)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column, name: str, slices: Sequence[Column] = ()
) -> DataFrame:
    """Sum of ``weight`` over the group's rows up to and including this one.

    ``order`` must be total within a group. ``slices`` are values that never fall along the order, the
    finest first; each further one numbers the slices of the one before. Without any, a group
    is one window: that is for groups that are small by their nature.
    """
    if not slices:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.sum(weight).over(upto))
    levels = [f"_slice{len(slices)}_{i}" for i in range(len(slices))]
    sliced = df.withColumns({"_weight": weight, **dict(zip(levels, slices))})
    totals = sliced.groupBy(*keys, *levels).agg(F.sum("_weight").alias("_total"))
    before = running_total(totals, keys, [F.asc(levels[0])], F.col("_total"), "_upto", [F.col(c) for c in levels[1:]])
    offsets = before.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col(levels[0]).alias("_at"), (F.col("_upto") - F.col("_total")).alias("_offset")
    )
    upto = Window.partitionBy(*keys, levels[0]).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = sliced.withColumn("_local", F.sum("_weight").over(upto))
    same = F.col(levels[0]).eqNullSafe(F.col("_at"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return inside.join(offsets, same).withColumn(name, F.col("_local") + F.col("_offset")).select(*df.columns, name)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, slices: Sequence[Column] = ()) -> DataFrame:
    """Row number from 1 within each group, as a bigint; see :func:`running_total` for ``slices``."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), name, slices)


def systematic_sample(df: DataFrame, order: Sequence[Column], k: int, slices: Sequence[Column]) -> DataFrame:
    """``k`` rows spread evenly over the order; all rows when ``k`` is not below the total.

    Row i (from 1) is picked when it equals ``int(j * n / k) + 1`` for some j in 0..k-1. ``slices``
    as in :func:`running_total`; the coarsest should leave few enough for one task to add up.
    """
    n = df.count()
    if k <= 0 or k >= n:
        return df
    picks = df.sparkSession.range(k).select((F.floor(F.col("id") * F.lit(n / k)) + 1).cast("bigint").alias("_row"))
    return numbered(df, [], order, "_row", slices).join(picks, "_row", "left_semi").drop("_row")
