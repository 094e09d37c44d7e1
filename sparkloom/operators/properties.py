"""Declared properties of a pipeline, checked on what it was given and gave: held, violated, or vacuous (nothing to check).

A pipeline is a function from tables to tables. Some properties look at one run; metamorphic ones run the pipeline again
on changed tables (rows in another order, a row more) and compare. Each check is an aggregate over tables that are
written once, so what reaches the driver is a verdict.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch

Tables = Mapping[str, DataFrame]
Pipeline = Callable[[Tables], Tables]
c = F.col


def written(tables: Tables) -> dict[str, DataFrame]:
    out = {}
    for name, df in tables.items():
        path = scratch(df.sparkSession)
        df.write.parquet(path)
        out[name] = df.sparkSession.read.schema(df.schema).parquet(path)
    return out


def verdict(name: str, seen: Column, broken: Column) -> Callable[[DataFrame], DataFrame]:
    """Over a table: vacuous if no row is seen, violated if one is broken."""
    n, bad = F.count_if(F.coalesce(seen, F.lit(False))), F.count_if(F.coalesce(seen & broken, F.lit(False)))
    return lambda df: df.agg(n.alias("n"), bad.alias("bad")).select(F.lit(name).alias("property"), F.when(c("bad") > 0, "violated").when(c("n") > 0, "held").otherwise("vacuous").alias("verdict"))


def never(name: str, df: DataFrame, broken: Column, among: Column | None = None) -> DataFrame:
    """No row of df (of those among) is broken."""
    return verdict(name, F.lit(True) if among is None else among, F.coalesce(broken, F.lit(False)))(df)


def same_keys(name: str, raw: DataFrame, raw_key: str, out: DataFrame, key: str) -> DataFrame:
    """Each key as often in the one as in the other: nothing dropped, no fan-out."""
    count = lambda df, k, n: df.groupBy(c(k).alias("key")).agg(F.count(F.lit(1)).alias(n))
    both = count(raw, raw_key, "was").join(count(out, key, "is"), "key", "full")
    return never(name, both, ~c("was").eqNullSafe(c("is")))


def conserved(name: str, raw: DataFrame, before: Column, out: DataFrame, after: Column, within: float) -> DataFrame:
    """A total is the same before and after; vacuous without rows before."""
    a = raw.agg(F.sum(before).cast("double").alias("was"), F.count(F.lit(1)).alias("rows"))
    both = a.join(out.agg(F.sum(after).cast("double").alias("is")), F.lit(True), "full")
    return verdict(name, c("rows") > 0, F.abs(F.coalesce("was", F.lit(0.0)) - F.coalesce("is", F.lit(0.0))) > within)(both)


def digest(df: DataFrame, digits: int) -> DataFrame:
    """(rows, sum): the same for two tables with the same rows in any order, doubles rounded."""
    kinds = dict(df.dtypes)
    columns = [F.round(c(x), digits) + 0.0 if kinds[x] in ("double", "float") else c(x) for x in sorted(df.columns)]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("sum"))


def same_output(name: str, one: Tables, two: Tables, digits: int = 6, among: bool = True) -> DataFrame:
    """All tables of two runs hold the same rows."""
    parts = []
    for table, df in one.items():
        a, b = digest(df, digits), digest(two[table], digits).select(c("rows").alias("rows2"), c("sum").alias("sum2"))
        parts.append(a.join(b, F.lit(True), "full"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return never(name, both, ~(c("rows").eqNullSafe(c("rows2")) & c("sum").eqNullSafe(c("sum2"))), F.lit(among))


def reordered(tables: Tables) -> dict[str, DataFrame]:
    """The same rows, dealt and ordered by their hash."""
    return {n: df.repartition(7, F.xxhash64(*df.columns)).sortWithinPartitions(F.xxhash64(*df.columns).desc()) for n, df in tables.items()}


def change_is_local(name: str, before: DataFrame, after: DataFrame, key: str, value: str, target: object, by: float, within: float) -> DataFrame:
    """A change moves the value of one key by so much, and of no other."""
    both = before.select(key, F.coalesce(c(value), F.lit(0)).alias("was")).join(after.select(key, F.coalesce(c(value), F.lit(0)).alias("is")), key, "full")
    wanted = F.when(c(key) == F.lit(target), by).otherwise(0.0)
    return never(name, both, ~F.coalesce(F.abs(c("is") - c("was") - wanted) <= within, F.lit(False)))


def check_properties(raw: Tables, pipeline: Pipeline, checks: Sequence[Callable[[Tables, Tables, Pipeline], DataFrame]]) -> DataFrame:
    """(property, verdict) of each check, which gets the raw tables, the pipeline's output for them, and the pipeline."""
    raw = written(raw)
    out = written(pipeline(raw))
    found = [check(raw, out, pipeline) for check in checks]
    told = found[0]
    for f in found[1:]:
        told = told.unionByName(f)
    return told
