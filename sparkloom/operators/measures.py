"""Aggregations and joins over facts: favourites, ladders, rollups, pivots, exact neighbours, order-free fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .nearest import candidates
from .ranks import numbered


def favourites(events: DataFrame, key: str, item: str) -> DataFrame:
    """Each key's most frequent item, the smallest on ties."""
    counts = events.groupBy(key, item).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), item))
    return counts.withColumn("_place", place).filter("_place = 1").select(key, F.col(item).alias("favourite"), "n")


def place_on_ladder(values: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """Each row with the highest cut that it reaches; null below all."""
    return values.withColumn("cut", F.array_max(F.filter(F.array(*map(F.lit, sorted(cuts))), lambda c: c <= F.col(value))))


def recount(values: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """How many rows reach each cut: rows are counted by rung before the shuffle, rungs are then summed from the top."""
    rungs = place_on_ladder(values, value, cuts).filter("cut is not null").groupBy("cut").agg(F.count(F.lit(1)).alias("n"))
    return rungs.select("cut", F.sum("n").over(Window.orderBy(F.desc("cut"))).alias("at_or_above"))


def rollup_series(facts: DataFrame, one: str, two: str, *measures: Column) -> DataFrame:
    """Measures for every combination of one or all with two or all, in one pass; null stands for all."""
    return facts.cube(one, two).agg(F.grouping_id().alias("level"), *measures)


def pivot_amounts(facts: DataFrame, key: str, kind: str, value: str, kinds: Sequence[str]) -> DataFrame:
    """A column for each kind with the sum of its values, 0 where a key has none."""
    return facts.groupBy(key).agg(*(F.sum(F.when(F.col(kind) == k, F.col(value)).otherwise(F.lit(0))).alias(k) for k in kinds))


def expected_grid(left: DataFrame, right: DataFrame, facts: DataFrame, value: Column) -> DataFrame:
    """Every combination of two small dimensions (each a column of facts), with its number of facts: absence is a row."""
    keys = [*left.columns, *right.columns]
    found = facts.groupBy(*keys).agg(value.alias("n"))
    return left.crossJoin(F.broadcast(right)).join(found, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def as_of(facts: DataFrame, key: str, ts: str, tie: str, rates: DataFrame, value: str) -> DataFrame:
    """Each fact with the latest rate of its key at or before it: both sides in one ordered pass, no range join. At the same time a rate comes first."""
    fact = facts.select(key, ts, tie, F.lit(None).cast(rates.schema[value].dataType).alias(value), F.lit(1).alias("_kind"))
    rate = rates.select(key, ts, F.lit(None).cast(facts.schema[tie].dataType).alias(tie), value, F.lit(0).alias("_kind"))
    order = Window.partitionBy(key).orderBy(ts, "_kind", tie, value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = fact.unionByName(rate).withColumn(value, F.last(value, ignorenulls=True).over(order))
    return both.filter("_kind = 1").drop("_kind")


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each column: rows, nulls, distinct values, least and greatest as text; one aggregation."""
    one = df.agg(*(F.struct(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_null"), F.count_distinct(F.col(c)).alias("n_distinct"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest")).alias(c) for c in columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("x")) for c in columns))).alias("y")).select("y.column_name", "y.x.*")


def knn(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Exact nearest neighbours by cosine, self excluded, ties by key. queries is a stated set, which meets the vectors
    in blocks; each pair of blocks keeps what can be among the best k before anything is shuffled."""
    near = candidates(vectors, queries, key, F.col(vector), k, cosine=True)
    scored = near.select("query_id", "neighbour_id", F.round(F.col("a") / F.sqrt(F.col("b") * F.col("c")), 6).alias("cosine"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "neighbour_id"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """Codes from 1 by falling frequency."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return numbered(counts, "code", F.desc("n"), F.col(column))


def n_per_group(df: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= n)
