"""Series of days: shocks, runs of them, changes over windows, vintages, splits, uplift by bins, adjusted p-values.

A daily series has one row for each day and key, so its windows are bounded by the calendar and not by the facts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shocks(daily: DataFrame, keys: Sequence[str], day: str, value: str, rows: int, least: int, limit: float) -> DataFrame:
    """Days far from the median of the rows before them, in standard deviations of those rows; a day with
    fewer than least rows before it is none."""
    before = Window.partitionBy(*keys).orderBy(day).rowsBetween(-rows, -1)
    known = daily.withColumn("_n", F.count(value).over(before)).withColumn("median", F.percentile(value, F.lit(0.5)).over(before))
    scale = F.stddev_pop(value).over(before)
    scored = known.withColumn("score", F.when((F.col("_n") >= least) & (scale > 0), F.round((F.col(value) - F.col("median")) / scale, 6)))
    return scored.filter(F.abs("score") >= limit).drop("_n")


def merge_runs(hits: DataFrame, keys: Sequence[str], day: str, score: str) -> DataFrame:
    """Neighbouring days (at most one apart) with the same sign as one run: its first and last day and largest score."""
    order = Window.partitionBy(*keys).orderBy(day)
    signed = hits.withColumn("_sign", F.signum(score).cast("int"))
    fresh = (F.datediff(day, F.lag(day).over(order)) > 1) | (F.col("_sign") != F.lag("_sign").over(order))
    runs = signed.withColumn("_new", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy(*keys, "_run").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days"), F.max(F.abs(score)).alias("largest")).drop("_run")


def changes(daily: DataFrame, keys: Sequence[str], day: str, value: str, windows: Sequence[int]) -> DataFrame:
    """Each day's change against so many calendar days before, for every window: earlier days are dealt forward to
    the days that ask for them, so one equi-join serves all windows."""
    ahead = daily.select(*keys, F.explode(F.array(*map(F.lit, windows))).alias("days"), F.col(day).alias("_from"), F.col(value).alias("_before"))
    ahead = ahead.select(*keys, "days", F.date_add("_from", F.col("days")).alias(day), "_before")
    return daily.join(ahead, [*keys, day]).select(*keys, day, "days", F.round(F.try_divide(F.col(value), F.col("_before")) - 1, 6).alias("change"))


def chain(links: DataFrame, keys: Sequence[str], period: str, factor: str) -> DataFrame:
    """The cumulative product of positive factors in each series."""
    order = Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return links.withColumn("level", F.round(F.exp(F.sum(F.ln(factor)).over(order)), 6))


def as_of_vintage(versions: DataFrame, key: Sequence[str], computed: str, tie: str, moment: Column) -> DataFrame:
    """The version of each key that was current at a moment: one aggregation, combined before the shuffle."""
    rest = [c for c in versions.columns if c not in (*key, computed, tie)]
    newest = F.max_by(F.struct(computed, tie, *rest), F.struct(computed, tie)).alias("x")
    return versions.filter(F.col(computed) <= moment).groupBy(*key).agg(newest).select(*key, "x.*")


def revisions(versions: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Versions whose value isn't the one before; the first of each key is initial."""
    w = Window.partitionBy(*key).orderBy(*order)
    marked = versions.withColumn("previous", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    kept = marked.filter(F.col("_first") | ~F.col("previous").eqNullSafe(F.col(value)))
    return kept.withColumn("reason", F.when(F.col("_first"), "initial").otherwise("revision")).drop("_first")


def hashed_split(df: DataFrame, key: str, percent: int) -> DataFrame:
    """test for a fixed share of the keys by their hash, else train: the same on every run and machine."""
    bucket = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(bucket < percent, "test").otherwise("train"))


def uplift_bins(units: DataFrame, score: Column, bins: int, treated: Column, outcome: Column) -> DataFrame:
    """Outcome rates of treated and control units by bin of a score from 0 to 1, and their difference. Bins have fixed
    edges, so units are counted before the shuffle and never sorted."""
    at = F.least(F.floor(score * bins), F.lit(bins - 1)).cast("long").alias("bin")
    sums = units.groupBy(at).agg(F.count_if(treated).alias("n_treated"), F.count_if(~treated).alias("n_control"), F.count_if(treated & outcome).alias("k_treated"), F.count_if(~treated & outcome).alias("k_control"))
    rate = lambda a: F.try_divide(F.col(f"k_{a}"), F.col(f"n_{a}"))
    return sums.withColumn("uplift", F.round(rate("treated") - rate("control"), 6))


def qini(binned: DataFrame) -> DataFrame:
    """The Qini curve over bins from the highest score down: treated successes less the control's, scaled to size."""
    order = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = {c: F.sum(c).over(order) for c in ("n_treated", "n_control", "k_treated", "k_control")}
    gain = run["k_treated"] - run["k_control"] * F.try_divide(run["n_treated"], run["n_control"])
    return binned.select("bin", run["n_treated"].alias("treated_so_far"), F.round(gain, 6).alias("qini"))


def benjamini_hochberg(tests: DataFrame, family: Sequence[str], p: str, tie: str) -> DataFrame:
    """Adjusted p-values within each family of tests."""
    place = Window.partitionBy(*family).orderBy(p, tie)
    ranked = tests.withColumn("_rank", F.row_number().over(place)).withColumn("_m", F.count("*").over(Window.partitionBy(*family)))
    down = Window.partitionBy(*family).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    adjusted = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down))
    return ranked.withColumn("adjusted", F.round(adjusted, 6)).drop("_rank", "_m")


def reliability(df: DataFrame, score: Column, truth: Column, bins: int) -> DataFrame:
    """Mean score and share of hits in equal bins of a score from 0 to 1."""
    at = F.least(F.floor(score * bins), F.lit(bins - 1)).cast("long").alias("bin")
    return df.groupBy(at).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_score"), F.round(F.avg(truth.cast("int")), 6).alias("hit_rate"))


def policy_profit(units: DataFrame, group: str, treated: Column, outcome: Column, least: int) -> DataFrame:
    """Mean outcome of treated and control units in each group, and the better choice where both have enough units."""
    sums = units.groupBy(group).agg(F.count_if(treated).alias("n_treated"), F.count_if(~treated).alias("n_control"), F.avg(F.when(treated, outcome)).alias("_t"), F.avg(F.when(~treated, outcome)).alias("_c"))
    enough = (F.col("n_treated") >= least) & (F.col("n_control") >= least)
    choice = F.when(enough, F.when(F.col("_t") > F.col("_c"), "treat").otherwise("leave"))
    return sums.select(group, "n_treated", "n_control", F.round("_t", 4).alias("mean_treated"), F.round("_c", 4).alias("mean_control"), choice.alias("choice"))


def segment_scan(units: DataFrame, features: Sequence[str], treated: Column, outcome: Column) -> DataFrame:
    """Uplift of every segment of one or two features: each unit becomes a row for each, then one aggregation."""
    singles = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features]
    pairs = [F.struct(F.lit(f"{a}+{b}").alias("feature"), F.concat_ws("+", a, b).alias("value")) for i, a in enumerate(features) for b in features[i + 1 :]]
    long = units.select(treated.alias("_t"), outcome.cast("int").alias("_y"), F.explode(F.array(*singles, *pairs)).alias("s"))
    mean = lambda t: F.avg(F.when(F.col("_t") == t, F.col("_y")))
    return long.groupBy("s.feature", "s.value").agg(F.count("*").alias("n"), F.round(mean(True) - mean(False), 6).alias("uplift"))


def profits(units: DataFrame, groups: Sequence[str], targeted: Column, treated: Column, outcome: Column, value: float, cost: float, least: int) -> DataFrame:
    """(groups, share, policy, treat_all, treat_none): profit for each unit if only the targeted ones are treated, if all
    are, if none is. Targeted units count by what treated ones among them gave, the others by control units; all three are
    null where a cell that is needed has fewer than `least` units. Units with a null in any of the three are left out."""
    rows = units.select(*groups, targeted.alias("_goal"), treated.alias("_t"), outcome.cast("double").alias("_y")).filter("_goal is not null and _t is not null and _y is not null")
    cell = lambda name, where: [F.count_if(where).alias(f"_n_{name}"), F.avg(F.when(where, F.col("_y"))).alias(f"_m_{name}")]
    goal, t = F.col("_goal"), F.col("_t")
    sums = rows.groupBy(*groups).agg(F.avg(goal.cast("int")).alias("share"), *cell("in", goal & t), *cell("out", ~goal & ~t), *cell("t", t), *cell("c", ~t))
    f = F.col("share")
    enough = (F.col("_n_t") >= least) & (F.col("_n_c") >= least) & ((f == 0) | (F.col("_n_in") >= least)) & ((f == 1) | (F.col("_n_out") >= least))
    policy = value * (F.when(f > 0, f * F.col("_m_in")).otherwise(0.0) + F.when(f < 1, (1 - f) * F.col("_m_out")).otherwise(0.0)) - cost * f
    return sums.select(*groups, "share", F.when(enough, policy).alias("policy"), F.when(enough, value * F.col("_m_t") - cost).alias("treat_all"), F.when(enough, value * F.col("_m_c")).alias("treat_none"))
