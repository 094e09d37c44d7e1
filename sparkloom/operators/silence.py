"""Sessions between silences, holds that run out, and how well found intervals overlap true ones. An empty table gives no
rows. The silences of moving things are in `tracks`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def sessions(reports: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, start, last, n): a key's reports with no silence of `gap` or longer between them."""
    held = reports.groupBy(key, F.session_window(ts, gap)).agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))
    return held.drop("session_window")


def expired(events: DataFrame, hold: str, ts: str, opens: Column, closes: Column, seconds: int, now: Column) -> DataFrame:
    """(hold, opened, deadline): holds whose deadline passed before now and before anything closed them."""
    sums = events.groupBy(hold).agg(F.min(F.when(opens, c(ts))).alias("opened"), F.min(F.when(closes, c(ts))).alias("_closed"))
    due = sums.filter("opened is not null").withColumn("deadline", c("opened") + F.make_dt_interval(secs=F.lit(seconds)))
    return due.filter((c("deadline") <= now) & (c("_closed").isNull() | (c("_closed") > c("deadline")))).drop("_closed")


def best_overlap(truth: DataFrame, found: DataFrame, key: str, start: str, end: str, share: float) -> DataFrame:
    """Each true interval with the found one of its key that overlaps it most (ties: the earlier), if by that share."""
    s = lambda x: F.unix_micros(x.cast("timestamp"))
    other = found.select(key, s(c(start)).alias("_s"), s(c(end)).alias("_e"))
    mine = truth.select(key, c(start), s(c(start)).alias("_from"), s(c(end)).alias("_to"))
    met = mine.join(other, key).withColumn("_over", F.least("_to", "_e") - F.greatest("_from", "_s")).filter(c("_over") > 0).filter(c("_over") >= share * (c("_to") - c("_from")))
    best = met.groupBy(key, start).agg(F.max("_over").alias("overlap_us"))
    return truth.select(key, start).distinct().join(best, [key, start], "left")
