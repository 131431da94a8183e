"""Exact positions over groups of any size.

A window without a partition, or with a hot one, sorts its group in one task.
``positions`` sorts by range instead, so a group spreads over many tasks, counts
each task's rows, and adds up the counts of the tasks before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from impactframe.session import materialize


def positions(df: DataFrame, by: list[str], order: list[Column], name: str, weight: str | None = None) -> DataFrame:
    """Add ``name``: the running count (or running sum of ``weight``) within ``by``, in ``order``."""
    # The written copy fixes which row landed in which range.
    ranged = materialize(
        df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id())
    )
    step = F.col(weight) if weight else F.lit(1).cast("bigint")
    within = W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    # One row per range and group: no more than ranges + groups in all.
    sizes = ranged.groupBy("_range", *by).agg(F.sum(step).alias("_size"))
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_range", *by, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    # Null group keys still belong together.
    keys = ["_range", *by]
    left = ranged.withColumn("_within", F.sum(step).over(within))
    right = offsets.select(*[F.col(k).alias(f"_o{k}") for k in keys], "_before")
    match = F.lit(True)
    for key in keys:
        match = match & left[key].eqNullSafe(right[f"_o{key}"])
    return (
        left.join(right, match)
        .withColumn(name, F.col("_within") + F.col("_before"))
        .drop("_range", "_within", "_before", *[f"_o{k}" for k in keys])
    )


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Ascending rank within ``by``; tied values share the average of their ranks."""
    # Ties collapse first, so a value held by half of all rows is one row here.
    distinct_values = df.groupBy(*by, value).agg(F.count("*").alias("_ties"))
    last = positions(distinct_values, by, [F.asc(value)], "_last", weight="_ties")
    ranks = last.select(*by, value, (F.col("_last") - (F.col("_ties") - 1) / F.lit(2.0)).alias(name))
    return df.join(ranks, [*by, value])


def top_rows(df: DataFrame, order: list[Column], top_n: int, name: str = "rank") -> DataFrame:
    """The first ``top_n`` rows with their 1-based rank; only those rows meet in one task."""
    first = df.orderBy(*order).limit(max(top_n, 0))
    return first.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("bigint"))
