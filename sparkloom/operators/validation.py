"""Boundary validation: ordered rules, reasoned quarantine, copies, layers that must agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, Column]]


def first_failure(rules: Rules) -> Column:
    """The name of the first rule whose condition holds (a null condition doesn't); null if none does."""
    out = F.lit(None).cast("string")
    for name, failed in reversed(rules):
        out = F.when(failed, F.lit(name)).otherwise(out)
    return out


def split_valid(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with reason and evidence as JSON); every row is in exactly one of them."""
    marked = df.withColumn("reason", first_failure(rules))
    valid = marked.filter(F.col("reason").isNull()).drop("reason")
    return valid, marked.filter(F.col("reason").isNotNull()).withColumn("evidence", F.to_json(F.struct(*df.columns)))


def exact_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each distinct row with the number of copies beyond the one kept, where there are any."""
    return df.groupBy(*(columns or df.columns)).agg((F.count(F.lit(1)) - 1).alias("copies")).filter("copies > 0")


def warn_counts(df: DataFrame, rules: Rules) -> DataFrame:
    """One row: how many rows each rule would warn about, in a single pass."""
    return df.agg(*(F.count_if(c).alias(n) for n, c in rules))


def latest_wins(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def resolve_copies(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each key: its copies, and whether they agree; keys whose copies conflict are to be quarantined whole."""
    rest = [c for c in df.columns if c not in keys]
    content = F.sha2(F.to_json(F.struct(*rest)), 256)
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min(content).alias("_low"), F.max(content).alias("_high"))
    return found.withColumn("conflict", F.col("_low") != F.col("_high")).drop("_low", "_high")


def dangling(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose key isn't null and isn't in parent."""
    return child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def reconcile(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ between two layers, absent ones included."""
    both = expected.select(key, F.col(value).alias("expected")).join(actual.select(key, F.col(value).alias("actual")), key, "full")
    return both.filter(~F.col("expected").eqNullSafe(F.col("actual")))
