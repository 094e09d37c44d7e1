"""Profiles and summaries of facts: users' years, order books, runs, categories, skew, arrival, drift, trade-offs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running


def user_year(days: DataFrame, key: str, day: str, n: str, support: int) -> DataFrame:
    """Totals of each key's days (one row for a key and day), in one aggregation: the weekend share is null below
    support; the busiest day and month are the earliest on ties."""
    months = F.array(*(F.sum(F.when(F.month(day) == m, F.col(n)).otherwise(0)) for m in range(1, 13)))
    weekend = F.sum(F.when(F.dayofweek(day).isin(1, 7), F.col(n)).otherwise(0))
    sums = days.groupBy(key).agg(
        F.sum(n).alias("n_events"),
        F.count("*").alias("n_days"),
        weekend.alias("weekend"),
        F.max_by(day, F.struct(F.col(n), -F.unix_date(day))).alias("busiest_day"),
        months.alias("months"),
    )
    share = F.when(F.col("n_events") >= support, F.round(F.col("weekend") / F.col("n_events"), 6))
    return sums.select(key, "n_events", "n_days", share.alias("weekend_share"), "busiest_day", F.array_position("months", F.array_max("months")).alias("busiest_month"))


def book_price(listings: DataFrame, book: Sequence[str], price: str, tie: Sequence[str], least: int) -> DataFrame:
    """Each book's interior lower quartile (never its lowest listing), median and size; books under least are left
    out. Listings are ranked by a window, which spills, so that a large book is never held whole."""
    ranked = listings.withColumn("_rank", F.row_number().over(Window.partitionBy(*book).orderBy(price, *tie))).withColumn("n", F.count("*").over(Window.partitionBy(*book)))
    at = F.greatest(F.lit(1), F.floor((F.col("n") - 1) / 4)) + 1
    middle = F.avg(F.when((F.col("_rank") == F.floor((F.col("n") + 1) / 2)) | (F.col("_rank") == F.floor(F.col("n") / 2) + 1), F.col(price)))
    return ranked.groupBy(*book).agg(F.max("n").alias("n"), F.max(F.when(F.col("_rank") == at, F.col(price))).alias("quartile"), middle.alias("median")).filter(F.col("n") >= least)


def daily_volume(fills: DataFrame, keys: Sequence[Column | str], value: str, quantity: str) -> DataFrame:
    """Volume and the price weighted by it; null where nothing was traded."""
    sums = fills.groupBy(*keys).agg(F.sum(quantity).alias("volume"), F.sum(value).alias("_value"))
    return sums.withColumn("vwap", F.when(F.col("volume") > 0, F.round(F.col("_value") / F.col("volume"), 6))).drop("_value")


def metrics_long(wide: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """A row for each metric of a key that isn't zero."""
    return wide.unpivot(key, list(metrics), "metric", "n").filter("n <> 0")


def drift(snapshot: DataFrame, deltas: DataFrame, key: str, level: str, delta: str) -> DataFrame:
    """Keys whose stored level isn't what their deltas add up to; a missing side counts as null."""
    replay = deltas.groupBy(key).agg(F.sum(delta).alias("replayed"))
    both = snapshot.select(key, F.col(level).alias("stored")).join(replay, key, "full")
    return both.filter(~F.col("stored").eqNullSafe(F.col("replayed")))


def summarise_runs(runs: DataFrame, key: str, value: str, ok: Column, order: Sequence[str], label: str) -> DataFrame:
    """Size, spread and outcome of each key's runs, and the label of its last one that wasn't ok."""
    mean, sd = F.avg(value), F.stddev_samp(value)
    return runs.groupBy(key).agg(
        F.count("*").alias("n"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
        F.round(mean, 6).alias("mean"),
        F.round(sd, 6).alias("sd"),
        F.round(F.when(mean != 0, sd / mean), 6).alias("cv"),
        F.bool_and(ok).alias("all_ok"),
        F.max_by(label, F.when(~ok, F.struct(*order))).alias("last_error"),
    )


def category_summary(selection: DataFrame, everything: DataFrame, category: str) -> DataFrame:
    """Of each category in a selection: its count, share, and lift over its share of everything."""
    def shares(df: DataFrame, n: str) -> DataFrame:
        counts = df.groupBy(category).agg(F.count("*").alias(n))
        return counts.crossJoin(F.broadcast(counts.agg(F.sum(n).alias(f"all_{n}"))))

    both = shares(selection, "n").join(shares(everything, "m").withColumnRenamed(category, "_c"), F.col(category).eqNullSafe(F.col("_c")))
    share = F.col("n") / F.col("all_n")
    return both.select(category, "n", F.round(share, 6).alias("share"), F.round(share / (F.col("m") / F.col("all_m")), 6).alias("lift"))


def rank_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Least, quartiles, greatest and mean of each group, from counts by value."""
    q = [F.percentile(value, F.lit(p), F.col("_n")).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    counts = df.groupBy(group, value).agg(F.count("*").alias("_n"))
    mean = F.round(F.sum(F.col(value) * F.col("_n")) / F.sum("_n"), 6)
    return counts.groupBy(group).agg(F.sum("_n").alias("n"), F.min(value).alias("least"), *q, F.max(value).alias("greatest"), mean.alias("mean"))


def confusion(df: DataFrame, truth: Column, verdict: Column) -> DataFrame:
    """One row: the four cells, precision and recall (null where there is nothing to divide by)."""
    cells = df.agg(F.count_if(truth & verdict).alias("tp"), F.count_if(~truth & verdict).alias("fp"), F.count_if(truth & ~verdict).alias("fn"), F.count_if(~truth & ~verdict).alias("tn"))
    ratio = lambda other: F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col(other)), 6)
    return cells.withColumn("precision", ratio("fp")).withColumn("recall", ratio("fn"))


def freshness(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Each key's newest time, its age behind the newest of all, and whether that is stale."""
    newest = df.groupBy(key).agg(F.max(ts).alias("newest"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    both = newest.crossJoin(F.broadcast(newest.agg(F.max("newest").alias("_now"))))
    return both.withColumn("age_us", micros("_now") - micros("newest")).withColumn("stale", F.col("age_us") > seconds * 1_000_000).drop("_now")


def skew_profile(df: DataFrame, key: str) -> DataFrame:
    """One row: how many rows a key has, at the 50th, 90th and 99th percentile (a value that occurs) and at most."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("keys"))
    total = sizes.agg(F.sum("keys")).first()[0] or 0
    upto = running(sizes, "sum", F.col("keys"), "_upto", F.col("n")).withColumn("_all", F.lit(total))
    at = lambda p: F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * F.lit(p)), F.col("n")))
    return upto.agg(F.sum("keys").alias("n_keys"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max("n").alias("most"))


def arrival_profile(events: DataFrame, source: str, arrival: str, ts: str) -> DataFrame:
    """Each source's events that came after a newer one, and the worst lateness in microseconds."""
    before = Window.partitionBy(source).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    lag = events.select(source, arrival, micros.alias("_us")).withColumn("_late", F.max("_us").over(before) - F.col("_us"))
    return lag.groupBy(source).agg(F.count("*").alias("n"), F.count_if(F.col("_late") > 0).alias("out_of_order"), F.greatest(F.lit(0), F.coalesce(F.max("_late"), F.lit(0))).alias("worst_us"))


def pareto(df: DataFrame, cost: str, value: str) -> DataFrame:
    """Costs (few distinct ones) that are worth their while: no smaller cost has as good a value, and each with its
    best value. A running maximum over one row for each cost, no self join."""
    best = df.groupBy(cost).agg(F.max(value).alias(value))
    return running(best, "max", F.col(value), "_before", F.col(cost), itself=False).filter(F.col("_before").isNull() | (F.col(value) > F.col("_before"))).drop("_before")


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row that doesn't depend on the order of rows: their number, and the xor and sum of a 32-bit hash of each."""
    # each value with its length before it, so that no two rows read alike; a null has none
    text = F.concat(*(F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns))
    hashed = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return df.select(hashed.alias("_h")).agg(F.count("*").alias("n"), F.bit_xor("_h").alias("xor"), F.sum("_h").alias("total"))


def node_counts(paths: DataFrame, levels: Sequence[str], flag: Column) -> DataFrame:
    """Rows and flagged rows at each node of a tree that the levels span, its root included."""
    return paths.rollup(*levels).agg(F.count("*").alias("n"), F.count_if(flag).alias("flagged"))


def recent_record(results: DataFrame, key: str, order: Sequence[Column], hit: Column, last: int) -> DataFrame:
    """Each key's share of hits over all its results and over the last so many."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    marked = results.withColumn("_place", place).withColumn("_hit", hit.cast("int"))
    return marked.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg("_hit"), 6).alias("hit_rate"), F.count_if((F.col("_place") <= last) & (F.col("_hit") == 1)).alias("recent_hits"))
