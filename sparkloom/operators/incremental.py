"""Incremental maintenance: only the days that new batches touch are built again.

Bronze is a table partitioned by (batch, day) to which batches are appended, so asking for the days of new batches and
for all rows of those days are both pruned scans. Copies of an event may come in any batch; a day is built whole from
bronze, its copies settled, and replaces that day's partition in one step. The files of other days stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import replace_partition


def append_batch(df: DataFrame, bronze: str, batch: int, day: Column) -> None:
    """Appends a batch; the same batch again replaces itself."""
    replace_partition(df.withColumns({"batch": F.lit(batch).cast("long"), "day": day}), bronze, "batch", "day")


def affected_days(bronze: DataFrame, after: int, upto: int | None = None) -> DataFrame:
    """(day,) of the rows in batches after one and up to another; rows without a day are in none."""
    new = bronze.filter(F.col("batch") > after)
    return (new if upto is None else new.filter(F.col("batch") <= upto)).select("day").filter("day is not null").distinct()


def first_copies(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Of rows with equal keys the first in the order (batch first)."""
    names = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct("batch", *order)).alias("kept_row"))
    return best.select(*keys, "kept_row.*").select(*rows.columns)


def rebuild_affected_days(spark: SparkSession, bronze: str, target: str, keys: Sequence[str], order: Sequence[str], after: int, upto: int | None = None) -> int:
    """Rebuilds the target's days that batches after `after` touch, from all batches up to `upto`; the last batch that
    the target holds from then on. Running it again with the same numbers gives the same files' contents."""
    rows = spark.read.parquet(bronze)
    last = rows.filter(F.col("batch") <= upto) if upto is not None else rows
    newest = last.agg(F.max("batch")).first()[0]
    if newest is None or newest <= after:
        return after
    days = affected_days(rows, after, upto)
    # day is a partition column: the days reach the scan at run time
    whole = last.join(days, "day", "left_semi")
    replace_partition(first_copies(whole, keys, *order), target, "day")
    return newest
