"""Time series and event logs: islands, gaps, standings, shocks, vintages, positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running


def streaks(days: DataFrame, key: str, day: str) -> DataFrame:
    """Each key's longest run of consecutive days, the earliest on ties. days may repeat a (key, day)."""
    numbered = days.select(key, day).distinct()
    island = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(key).orderBy(day)))
    runs = numbered.withColumn("_island", island).groupBy(key, "_island").agg(F.count(F.lit(1)).alias("length"), F.min(day).alias("first_day"))
    best = F.max_by(F.struct("length", "first_day"), F.struct(F.col("length"), -F.unix_date("first_day")))
    return runs.groupBy(key).agg(best.alias("x")).select(key, "x.length", "x.first_day")


def gaps(events: DataFrame, key: str, ts: str, least_seconds: int, tie: str) -> DataFrame:
    """Silences of at least so many seconds between neighbouring events of a key."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, tie))
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("gap_from").cast("timestamp"))
    found = events.select(key, ts, tie).withColumn("gap_from", before).withColumn("gap_us", seconds)
    return found.filter(F.col("gap_us") >= least_seconds * 1_000_000).select(key, tie, "gap_from", F.col(ts).alias("gap_to"), "gap_us")


def latest_state(events: DataFrame, key: str, ts: str, tie: str, *columns: str) -> DataFrame:
    """The newest row of each key, by one aggregation that combines before the shuffle."""
    newest = F.max_by(F.struct(ts, tie, *columns), F.struct(ts, tie)).alias("x")
    return events.groupBy(key).agg(newest).select(key, "x.*")


def merge_static(events: DataFrame, key: str, ts: str, tie: str, **fields) -> DataFrame:
    """For each field (name=column) the latest value that isn't null."""
    order = F.struct(ts, tie)
    return events.groupBy(key).agg(*(F.max_by(c, F.when(c.isNotNull(), order)).alias(n) for n, c in fields.items()))


def shift_join(daily: DataFrame, keys: Sequence[str], day: str, value: str, days: int) -> DataFrame:
    """Each day with the value of so many calendar days before; a day without one has no row."""
    before = daily.select(*keys, F.date_add(day, days).alias(day), F.col(value).alias("before"))
    return daily.join(before, [*keys, day]).select(*keys, day, value, "before")


def standing(counts: DataFrame, value: str, n: str) -> DataFrame:
    """For each distinct value how many rows are at or above it. counts: a row for each value, with its number of rows."""
    spread = counts.groupBy(value).agg(F.sum(n).alias("n"))
    return running(spread, "sum", F.col("n"), "at_or_above", F.desc(value))


def late(events: DataFrame, source: str, arrival: Sequence[str], ts: str, seconds: int) -> DataFrame:
    """Whether an event is further behind its source's newest one so far than allowed."""
    seen = running(events, "max", F.col(ts), "_newest", *(F.col(a) for a in arrival), by=[source])
    return seen.withColumn("late", F.col(ts) < F.col("_newest") - F.make_dt_interval(secs=F.lit(seconds))).drop("_newest")


def trailing_median(daily: DataFrame, keys: Sequence[str], day: str, value: str, rows: int, least: int) -> DataFrame:
    """The median of the rows before each day, null with fewer than least of them."""
    frame = Window.partitionBy(*keys).orderBy(day).rowsBetween(-rows, -1)
    median = F.when(F.count(value).over(frame) >= least, F.percentile(value, F.lit(0.5)).over(frame))
    return daily.withColumn("trailing_median", median)


def position_as_of(deltas: DataFrame, key: str, ts: str, delta: str, moment: str) -> DataFrame:
    """The sum of each key's deltas up to a moment; keys that start later are 0."""
    upto = F.col(ts) <= F.lit(moment).cast("timestamp_ntz")
    return deltas.groupBy(key).agg(F.coalesce(F.sum(F.when(upto, F.col(delta))), F.lit(0)).alias("position"), F.count_if(upto).alias("n_events"))


def second_counters(events: DataFrame, ts: str, identity: str, kind: str) -> DataFrame:
    """Events of each kind in each second, every id once."""
    return events.groupBy(F.date_trunc("second", F.col(ts)).alias("second"), kind).agg(F.count_distinct(identity).alias("n"))
