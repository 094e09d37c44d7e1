"""Ranks and running values over a whole order, without a window in one task.

Rows are dealt into ranges of the order and written once (a range is what a task sorts), each range is summed up, the
sums of the ranges before are added to running values within a range. Rows of equal order share a range; nulls come
first, as in an ascending sort, and last in a descending one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch


def _ranged(df: DataFrame, *order: Column) -> DataFrame:
    path = scratch(df.sparkSession)
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def running(df: DataFrame, what: str, column: Column, out: str, *order: Column, by: Sequence[str] = (), itself: bool = True, ties: bool = False) -> DataFrame:
    """df with out: the running sum or max (what) of column over the rows up to each one, of equal keys `by` if given,
    the row itself included or not; ties: rows of equal order see each other."""
    agg = {"sum": F.sum, "max": F.max}[what]
    rows = _ranged(df.withColumn("_value", column), *(F.col(k) for k in by), *order)
    parts = rows.groupBy("_range", *by).agg(agg("_value").alias("_part"))
    # a row for each range, and for each key that crosses into another one
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("_before", agg("_part").over(earlier)).drop("_part")
    w = Window.partitionBy("_range", *by).orderBy(*order)
    w = w.rangeBetween(Window.unboundedPreceding, Window.currentRow) if ties else w.rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    told = before.select(F.col("_range").alias("_at"), *(F.col(k).alias(f"_by_{k}") for k in by), "_before")
    same = F.col("_range") == F.col("_at")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    joined = rows.join(told, same).drop("_at", *(f"_by_{k}" for k in by))
    here = agg("_value").over(w)
    total = F.coalesce(F.col("_before") + here, F.col("_before"), here) if what == "sum" else F.greatest("_before", here)
    return joined.withColumn(out, total).drop("_range", "_value", "_before")


def numbered(df: DataFrame, out: str, *order: Column) -> DataFrame:
    """df with the place of each row in the order, from 1."""
    return running(df, "sum", F.lit(1).cast("long"), out, *order)
