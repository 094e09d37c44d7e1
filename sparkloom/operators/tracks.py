"""Silences of moving things, from their position reports (thing, ts, lat, lon, knots, course).

The chain: `reception_grid` tells how reliably each cell is heard, `silences` finds who fell silent, `neighbours` counts
who else was heard near there, `assess` joins the three and judges. Now is the newest report, not the clock on the wall:
if reports stop coming, not everything is silent. Reports with a null thing, time or place count for nothing; of reports
of one thing at one time the one with the least place counts. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import KNOT_MS, dead_reckon, haversine_m, libm_asin
from ..sources.workers import reachable
from .circles import others_near

c = F.col


@dataclass(frozen=True)
class Rules:
    """Thresholds of the chain; the defaults are fixed values that results depend on."""

    moving_s: float = 1800.0
    moored_s: float = 21600.0
    max_knots: float = 50.0
    cell_deg: float = 0.25
    least_reception: float = 0.8
    radius_m: float = 20_000.0
    lookback_h: float = 72.0
    #: A thing that was slower may have been moored, unless it turned up farther away than that.
    moored_knots: float = 1.0
    moored_m: float = 5000.0
    #: Shorter jumps are noise of the receiver.
    jump_m: float = 18_520.0
    #: Others are asked for where the thing should have been then, so long after it was last heard.
    spot_s: float = 900.0
    window_s: float = 1800.0


#: Points along the track, in seconds, whose reception counts; the points of a score. Fixed values.
TRACK_S = (0, 900, 1800)
BASE = {"dark": 45.0, "position_jump": 30.0, "coverage_gap": 5.0}
LONG_S, LENGTH_POINTS, OTHERS_POINTS, EACH_OTHER, UNDER_WAY_KNOTS, UNDER_WAY_POINTS, IMPOSSIBLE_POINTS, EXCESS_POINTS, EXCESS_EACH = 43_200, 10.0, 10.0, 2.0, 5, 5.0, 30.0, 10.0, 5.0
KEYS = ["thing", "silent_from"]


def seconds(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) / 1e6


def positions(reports: DataFrame, thing: str, ts: str, lat: str, lon: str, knots: str, course: str) -> DataFrame:
    """The chain's columns. Among equal (thing, ts) one stays: the aggregate combines before its shuffle."""
    named = reports.select(c(thing).alias("thing"), c(ts).alias("ts"), *(c(x).cast("double").alias(n) for x, n in ((lat, "lat"), (lon, "lon"), (knots, "knots"), (course, "course"))))
    known = named.filter("thing is not null and ts is not null and lat is not null and lon is not null")
    return known.groupBy("thing", "ts").agg(F.min(F.struct("lat", "lon", "knots", "course")).alias("at")).select("thing", "ts", "at.*")


def newest(at: DataFrame) -> Column:
    """The time of the newest report as a literal of its type, null if there is none."""
    found = at.agg(F.max("ts")).first()[0]
    return F.lit(None if found is None else str(found)).cast(at.schema["ts"].dataType)


def since(now: Column, rules: Rules) -> Column:
    return now - F.make_dt_interval(secs=F.lit(rules.lookback_h * 3600))


def reception_grid(at: DataFrame, now: Column, rules: Rules) -> DataFrame:
    """(cx, cy, hours_heard, hours_window, vessels, reliability) of the whole hours in the lookback before the newest:
    in how many of the hours that have any report each cell was heard."""
    hi = F.date_trunc("hour", now).cast(at.schema["ts"].dataType)
    held = at.filter((c("ts") >= hi - F.make_dt_interval(secs=F.lit(rules.lookback_h * 3600))) & (c("ts") < hi))
    hour = F.date_trunc("hour", "ts")
    # one row for each cell, thing and hour, combined before its shuffle
    heard = held.groupBy(F.floor(c("lon") / rules.cell_deg).alias("cx"), F.floor(c("lat") / rules.cell_deg).alias("cy"), "thing", hour.alias("hour")).agg(F.lit(1).alias("one"))
    every = held.agg(F.count_distinct(hour)).first()[0]
    cells = heard.groupBy("cx", "cy").agg(F.count_distinct("hour").alias("hours_heard"), F.count_distinct("thing").alias("vessels"))
    return cells.withColumn("hours_window", F.lit(every)).withColumn("reliability", c("hours_heard") / c("hours_window"))


def silences(at: DataFrame, now: Column, rules: Rules) -> DataFrame:
    """(thing, silent_from, silent_to, seconds, metres, and place, knots and course on both sides): silences as long as
    their threshold, jumps no thing can make however short, and those that are still silent, with nulls for what isn't
    known yet."""
    held = at.filter(c("ts") >= since(now, rules))
    w = Window.partitionBy("thing").orderBy("ts")
    names = ("ts", "lat", "lon", "knots", "course")
    both = held.select("thing", *(c(n).alias(f"{n}1") for n in names), *(F.lag(n).over(w).alias(f"{n}0") for n in names)).filter("ts0 is not null")
    both = both.withColumn("seconds", seconds(c("ts1")) - seconds(c("ts0"))).withColumn("metres", haversine_m(c("lat0"), c("lon0"), c("lat1"), c("lon1")))
    moved = (F.coalesce(c("knots0"), F.lit(0.0)) >= rules.moored_knots) | (c("metres") > rules.moored_m)
    long = c("seconds") >= F.when(moved, rules.moving_s).otherwise(rules.moored_s)
    jump = (c("metres") >= rules.jump_m) & (c("metres") / c("seconds") > rules.max_knots * KNOT_MS)
    columns = ["thing", c("ts0").alias("silent_from"), c("ts1").alias("silent_to"), "seconds", "metres", *(f"{n}{k}" for k in (0, 1) for n in names[1:])]
    return both.filter(long | jump).select(*columns).unionByName(open_silences(at, now, rules), allowMissingColumns=True)


def open_silences(at: DataFrame, now: Column, rules: Rules) -> DataFrame:
    """Things under way when last heard that are silent still."""
    last = at.groupBy("thing").agg(F.max_by(F.struct("ts", "lat", "lon", "knots", "course"), "ts").alias("x")).select("thing", "x.*")
    quiet = (c("ts") >= since(now, rules)) & (c("ts") <= now - F.make_dt_interval(secs=F.lit(rules.moving_s))) & (c("knots") >= rules.moored_knots)
    return last.filter(quiet).select("thing", c("ts").alias("silent_from"), (seconds(now) - seconds(c("ts"))).alias("seconds"), *(c(n).alias(f"{n}0") for n in ("lat", "lon", "knots", "course")))


def neighbours(gaps: DataFrame, at: DataFrame, rules: Rules) -> DataFrame:
    """(thing, silent_from, n_near): how many others reported, in the first window_s of each silence, within the radius
    of where the thing should have been; zero is kept. Both meet in blocks of place and time, around the date line and in
    the far north too; distances are then exact."""
    where = dead_reckon(c("lat0"), c("lon0"), c("knots0"), c("course0"), F.least(F.lit(rules.spot_s), c("seconds") / 2))
    spots = gaps.select(*KEYS, where[0].alias("lat"), where[1].alias("lon"), seconds(c("silent_from")).alias("t0"), (seconds(c("silent_from")) + F.least(F.lit(rules.window_s), c("seconds"))).alias("t1"))
    reports = at.select(c("thing").alias("other"), "lat", "lon", seconds(c("ts")).alias("t"))
    met = others_near(spots, reports, KEYS, rules.radius_m, rules.window_s)
    return gaps.select(*KEYS).join(met, KEYS, "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))


def reception(gaps: DataFrame, grid: DataFrame, rules: Rules) -> DataFrame:
    """(thing, silent_from, reception_from, reception_to): the worst cell along half an hour of track, ahead of where a
    thing vanished and behind where it came back (null while it hasn't); a cell that was never heard counts as 0."""
    side = lambda k, s: F.struct(F.lit(k).alias("side"), F.lit(float(s)).alias("s"), *(c(f"{n}{k}").alias(n) for n in ("lat", "lon", "knots", "course")))
    points = gaps.select(*KEYS, F.explode(F.array(*(side(k, sign * s) for k, sign in ((0, 1), (1, -1)) for s in TRACK_S))).alias("p")).select(*KEYS, "p.*")
    # cells are cut here, so the last bit counts
    reachable(gaps.sparkSession)
    lat, lon = dead_reckon(c("lat"), c("lon"), c("knots"), c("course"), c("s"), libm_asin)
    asked = points.select(*KEYS, "side", F.floor(lon / rules.cell_deg).alias("cx"), F.floor(lat / rules.cell_deg).alias("cy")).filter("cx is not null")
    told = asked.join(grid.select("cx", "cy", "reliability"), ["cx", "cy"], "left").withColumn("reliability", F.coalesce("reliability", F.lit(0.0)))
    worst = lambda side: F.min(F.when(c("side") == side, c("reliability")))
    return told.groupBy(*KEYS).agg(worst(0).alias("reception_from"), worst(1).alias("reception_to"))


def _text(x: Column, digits: int) -> Column:
    """x, not below zero, rounded as SQL engines do: the product decides a tie (138 of 240 hours are 0.57), not the
    decimal that the double is written as."""
    return (F.floor(x * 10**digits + 0.5) / 10**digits).cast("string")


def judged(facts: DataFrame, rules: Rules) -> DataFrame:
    """Silences with n_near and receptions: knots, verdict, impossible, score and reasons.

    Long enough silences are dark if the place was well heard on both sides and another thing was near, coverage_gap
    if not; what is too brief for its threshold is here for its jump only, a position_jump."""
    knots = c("metres") / c("seconds") / KNOT_MS
    impossible = F.coalesce((knots > rules.max_knots) & (c("metres") >= rules.jump_m), F.lit(False))
    moved = (F.coalesce(c("knots0"), F.lit(0.0)) >= rules.moored_knots) | (F.coalesce(c("metres"), F.lit(0.0)) > rules.moored_m)
    poor = lambda x: c(x) < rules.least_reception
    heard = ~poor("reception_from") & (c("reception_to").isNull() | ~poor("reception_to")) & (c("n_near") >= 1)
    verdict = F.when(c("seconds") < F.when(moved, rules.moving_s).otherwise(rules.moored_s), "position_jump").when(heard, "dark").otherwise("coverage_gap")
    out = facts.withColumns({"knots": knots, "impossible": impossible, "verdict": verdict})
    dark, gap = c("verdict") == "dark", c("verdict") == "coverage_gap"
    base = F.when(dark, BASE["dark"]).when(gap, BASE["coverage_gap"]).otherwise(BASE["position_jump"])
    under_way = dark & (F.coalesce(c("knots0"), F.lit(0.0)) >= UNDER_WAY_KNOTS)
    length = F.when(dark, F.least(F.lit(LENGTH_POINTS), LENGTH_POINTS * c("seconds") / LONG_S) + F.least(F.lit(OTHERS_POINTS), EACH_OTHER * c("n_near"))).otherwise(0.0)
    excess = F.when(c("impossible"), IMPOSSIBLE_POINTS + F.least(F.lit(EXCESS_POINTS), EXCESS_EACH * F.log10(c("knots") / rules.max_knots))).otherwise(0.0)
    score = F.round(F.least(F.lit(100.0), base + length + F.when(under_way, UNDER_WAY_POINTS).otherwise(0.0) + excess), 1)
    minutes = F.floor(c("seconds") / 60 + 0.5)
    hours = F.floor(minutes / 60)
    said = F.when(hours > 0, F.concat(hours.cast("string"), F.lit(" h "), F.lpad((minutes % 60).cast("string"), 2, "0"), F.lit(" min"))).otherwise(F.concat(minutes.cast("string"), F.lit(" min")))
    others = F.concat(c("n_near").cast("string"), F.when(c("n_near") == 1, " other was heard nearby").otherwise(" others were heard nearby"))
    reasons = F.array_compact(
        F.array(
            F.concat(F.lit("silent for "), said, F.when(c("silent_to").isNull(), ", not heard again yet").otherwise("")),
            F.when(dark, F.concat(F.lit("reception "), _text(c("reception_from"), 2), F.lit(" where it vanished"), F.coalesce(F.concat(F.lit(", "), _text(c("reception_to"), 2), F.lit(" where it returned")), F.lit("")))),
            F.when(dark, others),
            F.when(under_way, F.concat(F.lit("under way at "), _text(c("knots0"), 1), F.lit(" kn when it vanished"))),
            F.when(gap & poor("reception_from"), F.concat(F.lit("was leaving reliable coverage, reception "), _text(c("reception_from"), 2))),
            F.when(gap & poor("reception_to"), F.concat(F.lit("returned from outside reliable coverage, reception "), _text(c("reception_to"), 2))),
            F.when(gap & (c("n_near") == 0), "nobody else was heard nearby: the receiver may have been down"),
            F.when(c("impossible"), F.concat(F.lit("reappeared "), F.floor(c("metres") / 1852 + 0.5).cast("string"), F.lit(" nm away: needs "), F.floor(c("knots") + 0.5).cast("string"), F.lit(" kn"))),
        )
    )
    return out.withColumns({"score": score, "reasons": F.array_join(reasons, "; ")})


def assess(at: DataFrame, grid: DataFrame, now: Column, rules: Rules) -> DataFrame:
    """The whole chain over positions: a judged row for each silence in the lookback."""
    gaps = silences(at, now, rules)
    facts = gaps.join(neighbours(gaps, at, rules), KEYS).join(reception(gaps, grid, rules), KEYS)
    return judged(facts, rules).select(*KEYS, "silent_to", "seconds", "metres", "knots", "reception_from", "reception_to", "n_near", "verdict", "impossible", "score", "reasons")
