"""Prices of books of listings, baskets of them and index levels that tell how much of the basket was seen.

A cell is a (market, item). Prices that are null or not above zero make no estimate; empty tables give empty results.
Everything is grouped by cell and period: no group holds more than one book, one cell's calendar or one market's items.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from math import log
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ..sources.scratch import scratch

c = F.col
#: Scale from a median distance to a standard deviation, and its floor in log units.
NORMAL, FLOOR = 1.4826, 0.02
#: Log distance from the consensus, from the own history, and of a price nobody paid.
CROSS_LIMIT, OWN_FLOOR, OWN_SCALES, UNTRADED_LIMIT = log(4), log(4), 5.0, log(1.5)
#: Markets that make a consensus, accepted prices kept and needed.
MARKETS, KEPT, NEEDED = 3, 14, 5


def snapshot_prices(listings: DataFrame, book: Sequence[str], price: str, least: int, extreme: float = 5.0) -> DataFrame:
    """A row for each book: listings, the price at the lower quartile but never the cheapest one (null below least
    listings), mean, listings whose log price is extreme robust deviations off the median, the largest such, the range."""
    sells = listings.filter(c(price) > 0).withColumn("_log", F.ln(price))
    w = Window.partitionBy(*book)
    off = sells.withColumn("_off", F.abs(c("_log") - F.percentile("_log", F.lit(0.5)).over(w)))
    z = off.withColumn("_z", c("_off") / F.greatest(F.percentile("_off", F.lit(0.5)).over(w) * NORMAL, F.lit(FLOOR)))
    n = F.count(F.lit(1))
    at = F.least(F.greatest(F.floor((n - 1) / 4), F.lit(1)), n - 1) + 1
    robust = F.when(n >= least, F.element_at(F.array_sort(F.collect_list(price)), at.cast("int")))
    return z.groupBy(*book).agg(
        n.alias("n"), robust.alias("price"), F.avg(price).alias("naive_mean"), F.count_if(c("_z") > extreme).alias("n_extreme"),
        F.max("_z").alias("max_z"), F.min(price).alias("min_price"), F.max(price).alias("max_price"),
    )


def daily_price(snapshots: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each expected key: the median of its snapshots' prices, and ok, thin (listings, but no price) or missing."""
    seen = snapshots.groupBy(*keys).agg(
        F.percentile("price", F.lit(0.5)).alias("price"), F.count("price").alias("n_obs"), F.max("n").alias("max_listings"),
        F.sum("n_extreme").alias("n_extreme"), F.max("max_z").alias("max_z"),
    )
    status = F.when(c("price").isNotNull(), "ok").when(c("max_listings") > 0, "thin").otherwise("missing")
    return expected.join(seen, list(keys), "left").fillna(0, ["n_obs"]).withColumn("status", status)


def snapshot_pairs(listings: DataFrame, cell: Sequence[str], snapshot: str) -> DataFrame:
    """(cell, previous, snapshot): each snapshot of a cell beside the one before it; the first has none and is left out."""
    order = Window.partitionBy(*cell).orderBy(snapshot)
    taken = listings.select(*cell, snapshot).distinct().withColumn("previous", F.lag(snapshot).over(order))
    return taken.filter("previous is not null")


def _stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def infer_fills(listings: DataFrame, cell: Sequence[str], snapshot: str, order: str, price: str, left: str, total: str, expires: str) -> DataFrame:
    """(cell, snapshot, fill_qty, fill_value, new_value) between a cell's neighbouring snapshots. An order that shrank was
    filled in part. One that vanished before it expired was filled if no dearer than the dearest partial fill, or the
    cheapest listing left where there is none, or any price where nothing is left; else it was withdrawn."""
    key = [*cell, snapshot]
    # what is joined is written, so that a table of cells and snapshots goes to the listings if it is small
    kept = _stored(listings.select(*key, c(order).alias("_order"), c(price).alias("_price"), c(left).alias("_left"), c(total).alias("_total"), c(expires).alias("_ends")))
    pairs = _stored(snapshot_pairs(kept, cell, snapshot))
    old = kept.withColumnRenamed(snapshot, "previous").join(pairs, [*cell, "previous"]).select(*key, "_order", c("_price").alias("_p"), c("_left").alias("_had"), "_ends")
    new = kept.join(pairs.drop("previous"), key).select(*key, "_order", c("_price").alias("_q"), c("_left").alias("_has"), "_total")
    met = old.join(new, [*key, "_order"], "full")
    partial, gone = c("_has") < c("_had"), c("_has").isNull() & (c("_ends") > c(snapshot))
    money = lambda quantity, at: F.sum(F.coalesce(quantity * c(at), F.lit(0)))
    sold = F.when(partial, c("_had") - c("_has")).otherwise(0)
    fresh = F.when(c("_had").isNull(), c("_q") * c("_total")).otherwise(0)
    # only what vanished has to wait for its cell's edge, by its price: the rest is summed up at once
    lost = F.coalesce(gone, F.lit(False))
    sums = met.groupBy(*key, lost.alias("_lost"), F.when(lost, c("_p")).alias("_at")).agg(
        F.max(F.when(partial, c("_p"))).alias("_dearest"), F.min("_q").alias("_cheapest"), F.sum(sold).alias("_sold"), money(sold, "_p").alias("_value"),
        F.sum(F.when(lost, c("_had"))).alias("_had"), F.sum(fresh).alias("_fresh"),
    )
    sums = _stored(sums)
    edges = sums.groupBy(*key).agg(F.coalesce(F.max("_dearest"), F.min("_cheapest"), F.lit(float("inf"))).alias("_edge"))
    filled = F.coalesce(F.when(c("_lost") & (c("_at") <= c("_edge")), c("_had")), F.lit(0))
    dealt = sums.join(edges, key).withColumn("_filled", filled)
    return dealt.groupBy(*key).agg(F.sum(c("_sold") + c("_filled")).cast("long").alias("fill_qty"), F.sum(c("_value") + F.coalesce(c("_filled") * c("_at"), F.lit(0))).alias("fill_value"), F.sum("_fresh").alias("new_value"))


def cap_weights(cells: DataFrame, group: str, size: str, cap: float, tie: Sequence[str], out: str = "share") -> DataFrame:
    """cells with each one's share of its group's size, none above cap: what is over goes to the others in proportion;
    equal shares where the cap can't hold. The capped ones are a prefix of the order by size, so it takes no rounds:
    place i is over while its part of what places 1 to i - 1 left over is."""
    order = Window.partitionBy(group).orderBy(F.desc(size), *tie)
    every, before = Window.partitionBy(group), order.rowsBetween(Window.unboundedPreceding, -1)
    told = cells.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(every))
    told = told.withColumn("_rest", F.sum(size).over(every) - F.coalesce(F.sum(size).over(before), F.lit(0)))
    fits = c(size) * (1 - (c("_i") - 1) * cap) <= cap * c("_rest")
    told = told.withColumn("_first", F.min(F.when(fits, c("_i"))).over(every))
    free = F.max(F.when(c("_i") == c("_first"), c("_rest"))).over(every)
    share = F.when(c("_n") * cap <= 1, 1 / c("_n")).when(c("_i") < c("_first"), F.lit(cap)).otherwise(c(size) * (1 - (c("_first") - 1) * cap) / free)
    return told.withColumn(out, share).drop("_i", "_n", "_rest", "_first")


def build_basket(daily: DataFrame, market: str, item: str, base: Column, least: int, cap: float, value: float) -> DataFrame:
    """(market, item, weight, base_price, expenditure, quantity) of the cells of daily (market, item, price, volume) with
    at least least priced days, a price in the base window and an expenditure: a market weighs what is spent there, an
    item at most cap of its market."""
    priced = daily.filter(c("price").isNotNull())
    spent = F.sum((F.round(c("price") * 1000).cast("long") * F.coalesce(c("volume"), F.lit(0))).cast("long"))
    cells = priced.groupBy(market, item).agg(F.count(F.lit(1)).alias("_days"), spent.alias("expenditure"), F.percentile(F.when(base, c("price")), F.lit(0.5)).alias("base_price"))
    fit = cells.filter((c("_days") >= least) & (c("expenditure") > 0) & c("base_price").isNotNull()).drop("_days")
    markets = fit.groupBy(market).agg(F.sum("expenditure").alias("_market"))
    world = markets.agg(F.sum("_market").alias("_world"))  # one row
    weighed = cap_weights(fit, market, "expenditure", cap, [item]).join(markets, market).crossJoin(F.broadcast(world))
    weight = c("share") * c("_market") / c("_world")
    return weighed.select(market, item, weight.alias("weight"), "base_price", "expenditure", (weight * value / c("base_price")).alias("quantity"))


def group_relatives(basket: DataFrame, prices: DataFrame, market: str, item: str, division: str, day: str) -> DataFrame:
    """(day, market, division, full, seen, moved, n_seen): a group's whole weight, the weight of its cells with a price
    that day, and that weight times price over base price. Days come from prices; a basket is dealt over them as an
    array, which is as long as a calendar."""
    days = prices.agg(F.array_sort(F.collect_set(day)).alias("_days"))  # one row, a calendar long
    grid = basket.crossJoin(F.broadcast(days)).withColumn(day, F.explode("_days")).drop("_days")
    met = grid.join(prices.select(market, item, day, "price"), [market, item, day], "left").withColumn("_rel", c("price") / c("base_price"))
    seen = c("_rel").isNotNull()
    return met.groupBy(day, market, division).agg(F.sum("weight").alias("full"), F.sum(F.when(seen, c("weight")).otherwise(0)).alias("seen"), F.sum(F.coalesce(c("weight") * c("_rel"), F.lit(0))).alias("moved"), F.count("_rel").alias("n_seen"))


def aggregate(groups: DataFrame, market: str, division: str, day: str) -> DataFrame:
    """(scope, division, day, relative, coverage, n_items) for each market and division and for all of either: groups
    of which half the weight was seen speak for the rest of theirs, others for nothing."""
    speaks = c("seen") * 2 >= c("full")
    cube = groups.withColumn("_grid", F.array(*(F.struct(s.alias("scope"), v.alias("_division")) for s in (c(market).cast("string"), F.lit("all")) for v in (c(division).cast("string"), F.lit("all")))))
    flat = cube.select("*", F.explode("_grid").alias("_g")).select(day, "_g.scope", c("_g._division").alias("division"), "full", "seen", "moved", "n_seen")
    part = F.sum(F.when(speaks, c("full") * c("moved") / c("seen"))) / F.nullif(F.sum(F.when(speaks, c("full"))), F.lit(0))
    share = F.least(F.lit(1.0), F.sum("seen") / F.sum("full"))
    return flat.groupBy("scope", "division", day).agg(part.alias("relative"), F.round(share, 9).alias("coverage"), F.sum("n_seen").alias("n_items"))


def link_factors(levels: DataFrame, least: float = 0.5) -> DataFrame:
    """(scope, division, link): the old basket's relatives at the prices both baskets know, where enough was seen."""
    return levels.filter(c("relative").isNotNull() & (c("coverage") >= least)).select("scope", "division", c("relative").alias("link"))


def index_values(levels: DataFrame, links: DataFrame, ok: float = 0.9, least: float = 0.5) -> DataFrame:
    """levels with status ok, partial or insufficient by coverage, and value = link * relative; no link or too little
    seen: no value, never one carried on."""
    bad = c("relative").isNull() | c("link").isNull() | (c("coverage") < least)
    told = levels.join(links, ["scope", "division"], "left").withColumn("status", F.when(bad, "insufficient").when(c("coverage") < ok, "partial").otherwise("ok"))
    return told.withColumn("value", F.when(~bad, F.round(c("link") * c("relative"), 6))).drop("relative", "link")


def consensus(daily: DataFrame, item: str, day: str, price: str, volume: str, vwap: str | None = None) -> DataFrame:
    """daily with paid (something was traded, and near this price if vwap is named), and what its item's paid prices of
    that day say: markets that make them (n_traded) and the median of their logs (cross_log)."""
    near = F.abs(F.ln(price) - F.ln(vwap)) <= UNTRADED_LIMIT if vwap else F.lit(True)
    told = daily.withColumn("paid", F.coalesce((c(volume) > 0) & near, F.lit(False)))
    votes = told.filter((c(price) > 0) & c("paid")).groupBy(item, day).agg(F.count(F.lit(1)).alias("n_traded"), F.percentile(F.ln(price), F.lit(0.5)).alias("cross_log"))
    return told.join(votes, [item, day], "left").fillna(0, ["n_traded"])


def _judge(logged: float, kept: deque, paid: bool, markets: int, cross: float) -> tuple[str | None, float]:
    """Why a log price isn't accepted, if so, and how far off it is as a multiple of the limit."""
    if markets >= MARKETS:
        far, limit, kind = abs(logged - cross), CROSS_LIMIT, "cross_market"
    elif len(kept) >= NEEDED:
        past = list(kept)
        steps = [abs(b - a) for a, b in zip(past[:-1], past[1:], strict=True)]
        far, limit, kind = abs(logged - median(past)), max(OWN_SCALES * NORMAL * median(steps), OWN_FLOOR), "own_history"
    else:
        return None, 0.0
    return kind if far > limit else "untraded" if far > UNTRADED_LIMIT and not paid else None, far / limit


def accept_daily(daily: DataFrame, market: str, item: str, day: str, price: str, volume: str, vwap: str | None = None) -> DataFrame:
    """daily with reason, why a price isn't accepted (null: it is, or there is none), distance as a multiple of the limit,
    and accepted, the price if it is. Where three markets traded the item that day, one far from the median of their
    prices is refused; elsewhere one far from the cell's own last accepted prices; and a price nobody paid is held to a
    nearer limit. Only accepted prices become history, so a cell's days are folded in order: one task holds one cell's
    calendar. One row for each (market, item, day) is expected; of more, each is judged in turn."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame, kept, told = frame.sort_values(day, kind="stable"), deque(maxlen=KEPT), []
        for p, paid, markets, cross in zip(frame[price], frame["paid"], frame["n_traded"], frame["cross_log"], strict=True):
            if not p > 0:
                told.append((None, None))
                continue
            told.append(_judge(log(p), kept, paid, markets, cross))
            if told[-1][0] is None:
                kept.append(log(p))
        return frame.assign(reason=[t[0] for t in told], distance=[t[1] for t in told])

    known = consensus(daily, item, day, price, volume, vwap)
    schema = StructType([*known.schema.fields, StructField("reason", StringType()), StructField("distance", DoubleType())])
    judged = known.groupBy(market, item).applyInPandas(fold, schema)
    return judged.withColumn("accepted", F.when(c("reason").isNull() & (c(price) > 0), c(price)))


def manipulation_events(daily: DataFrame, keys: Sequence[str], day: str, thin: int = 10, jump: float = log(1.75)) -> DataFrame:
    """(keys, day, kind, severity, depth, thin) of daily (price, max_listings, n_extreme, max_z, reason, distance): books
    with extreme listings, refused prices, and thin days that jump from the median of up to 14 rows before (5 needed)."""
    rows = daily.withColumn("depth", F.coalesce(c("max_listings"), F.lit(0)).cast("long"))
    before = Window.partitionBy(*keys).orderBy(day).rowsBetween(-14, -1)
    rows = rows.withColumn("_log", F.ln("price"))
    rows = rows.withColumn("_ref", F.when(F.count("_log").over(before) >= 5, F.percentile("_log", F.lit(0.5)).over(before)))
    off = F.abs(c("_log") - c("_ref"))
    kinds = [
        ("extreme_listing", c("n_extreme") > 0, c("max_z")),
        ("rejected_price", c("reason").isNotNull(), c("distance")),
        ("thin_market_spike", (c("depth") < thin) & (off >= jump), off / jump),
    ]
    told = F.array_compact(F.array(*(F.when(is_, F.struct(F.lit(k).alias("kind"), F.coalesce(s, F.lit(0.0)).alias("severity"))) for k, is_, s in kinds)))
    return rows.select(*keys, day, "depth", (c("depth") < thin).alias("thin"), F.explode(told).alias("_e")).select(*keys, day, "_e.kind", F.least("_e.severity", F.lit(1e9)).alias("severity"), "depth", "thin")


def attribute(shocks: DataFrame, releases: DataFrame, day: str, topic: str, released: str, release: str, topics: str, major: str, lookback: int) -> DataFrame:
    """Each shock's releases of its day and the lookback days before, with lag_hours to the shock's noon (0 if later),
    relevance = topic * exp(-lag / 48) and rank. topic: 1 over the place of the shock's topic among the release's, else
    0.5 for a major one and 0.15 for others; a shock without topic takes 0.8 of any release that has topics. Releases
    are dealt to the days that look back at them, so one equi-join finds the pairs."""
    dealt = releases.withColumn(day, F.explode(F.sequence(F.to_date(released), F.date_add(F.to_date(released), lookback))))
    met = shocks.join(dealt, day)
    at = F.array_position(topics, c(topic))
    weight = F.when(c(topic).isNull() & (F.size(topics) > 0), 0.8).when(at > 0, 1 / at).when(c(major), 0.5).otherwise(0.15)
    noon = F.unix_micros(c(day).cast("timestamp")) + 12 * 3_600_000_000
    lag = F.greatest(F.lit(0.0), (noon - F.unix_micros(c(released).cast("timestamp"))) / 3_600_000_000)
    told = met.withColumn("lag_hours", lag).withColumn("relevance", weight * F.exp(-c("lag_hours") / 48))
    keys = [x for x in shocks.columns]
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("relevance", 9)), "lag_hours", release)
    return told.select(*keys, release, F.round("lag_hours", 2).alias("lag_hours"), F.round(F.least(F.lit(1.0), "relevance"), 4).alias("relevance"), F.row_number().over(order).alias("rank"))


def release_impact(daily: DataFrame, keys: Sequence[str], day: str, value: str, releases: DataFrame, release: str, rows: int = 7, least: int = 4) -> DataFrame:
    """(release, keys, log_change, robust_z): the median log level of the rows after a release's day less that of the rows
    before, against the same change of every other day of the series; least values are needed on either side."""
    w = Window.partitionBy(*keys).orderBy(day)
    known = daily.filter(c(value) > 0).withColumn("_log", F.ln(value))

    def side(a: int, b: int) -> Column:
        frame = w.rowsBetween(a, b)
        return F.when(F.count("_log").over(frame) >= least, F.percentile("_log", F.lit(0.5)).over(frame))

    moved = known.withColumn("log_change", side(1, rows) - side(-rows, -1)).filter("log_change is not null")
    every = Window.partitionBy(*keys)
    off = moved.withColumn("_mid", F.percentile("log_change", F.lit(0.5)).over(every))
    off = off.withColumn("_mad", F.percentile(F.abs(c("log_change") - c("_mid")), F.lit(0.5)).over(every) * NORMAL)
    z = (c("log_change") - c("_mid")) / F.greatest("_mad", F.lit(1e-4))
    return releases.join(off, day).select(release, *keys, "log_change", z.alias("robust_z"))
