"""Queries of prices, baskets and index levels over listings made from line items, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prices as P
from .tables import _t, query


_UNIT = "l_extendedprice / l_quantity"


def _listing_sql(items: int, price: str = _UNIT) -> str:
    return f"l AS (SELECT l_suppkey % 4 AS market, l_partkey % {items} AS item, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, {price} AS price, CAST(l_quantity AS BIGINT) AS volume FROM lineitem)"


def _listings(spark, d, items, price=_UNIT):
    return _t(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 4).alias("market"), (F.col("l_partkey") % items).alias("item"), F.trunc("l_shipdate", "month").alias("month"),
        F.expr(price).alias("price"), F.col("l_quantity").cast("long").alias("volume"),
    )


_BOOK = ["market", "item", "month"]


def _snapshot_sql(items: int, price: str = _UNIT) -> str:
    w = "OVER (PARTITION BY market, item, month)"
    return f"""{_listing_sql(items, price)}, m AS (SELECT *, abs(ln(price) - median(ln(price)) {w}) AS off FROM l), z AS (SELECT *, off / greatest(median(off) {w} * 1.4826, 0.02) AS z FROM m),
 s AS (SELECT market, item, month, count(*) AS n, CASE WHEN count(*) >= 3 THEN list_sort(list(price))[CAST(least(greatest((count(*) - 1) // 4, 1), count(*) - 1) + 1 AS BIGINT)] END AS price, avg(price) AS naive_mean,
 count(*) FILTER (z > 5) AS n_extreme, max(z) AS max_z, min(price) AS min_price, max(price) AS max_price FROM z GROUP BY 1, 2, 3)"""


def _rounded(df, **digits):
    return df.select(*(F.round(c, digits[c]).alias(c) if c in digits else c for c in df.columns))


@query(f"WITH {_snapshot_sql(50, 'l_extendedprice')} SELECT market, item, month, n, price, round(naive_mean, 6) AS naive_mean, n_extreme, round(max_z, 5) AS max_z, min_price, max_price FROM s")
def A06_snapshot_prices(spark, d):
    return _rounded(P.snapshot_prices(_listings(spark, d, 50, "l_extendedprice"), _BOOK, "price", 3), naive_mean=6, max_z=5)


@query(f"""WITH {_snapshot_sql(200)}, q AS (SELECT *, CAST(date_trunc('quarter', month) AS DATE) AS quarter FROM s), g AS (SELECT * FROM (SELECT DISTINCT market, item FROM q), (SELECT DISTINCT quarter FROM q)),
 a AS (SELECT market, item, quarter, median(price) AS price, count(price) AS n_obs, max(n) AS max_listings, CAST(sum(n_extreme) AS BIGINT) AS n_extreme, round(max(max_z), 5) AS max_z FROM q GROUP BY 1, 2, 3)
 SELECT market, item, quarter, price, coalesce(n_obs, 0) AS n_obs, max_listings, n_extreme, max_z, CASE WHEN price IS NOT NULL THEN 'ok' WHEN max_listings > 0 THEN 'thin' ELSE 'missing' END AS status FROM g LEFT JOIN a USING (market, item, quarter)""")
def A07_daily_price(spark, d):
    snaps = P.snapshot_prices(_listings(spark, d, 200), _BOOK, "price", 3).withColumn("quarter", F.trunc("month", "quarter"))
    expected = snaps.select("market", "item").distinct().crossJoin(F.broadcast(snaps.select("quarter").distinct()))  # a calendar of quarters
    return _rounded(P.daily_price(snaps, expected, ["market", "item", "quarter"]), max_z=5)


_ORDERS = """o AS (SELECT l_orderkey * 8 + l_linenumber AS order_id, min(l_suppkey % 4) AS market, min(l_partkey % 10) AS item, min(CAST(date_trunc('month', l_shipdate) AS DATE)) AS issued, max(CAST(l_quantity AS BIGINT)) AS total, min(l_extendedprice) AS price FROM lineitem GROUP BY 1),
 b AS (SELECT *, issued AS snapshot, total AS had FROM o UNION ALL SELECT *, CAST(issued + INTERVAL 1 MONTH AS DATE), CASE order_id % 3 WHEN 1 THEN total ELSE total // 2 END FROM o WHERE order_id % 3 <> 0)"""


def _orders(spark, d):
    one = _t(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("order_id")).agg(
        F.min(F.col("l_suppkey") % 4).alias("market"), F.min(F.col("l_partkey") % 10).alias("item"), F.min(F.trunc("l_shipdate", "month")).alias("issued"),
        F.max(F.col("l_quantity").cast("long")).alias("total"), F.min("l_extendedprice").alias("price"),
    )
    later = one.filter("order_id % 3 <> 0").selectExpr("*", "add_months(issued, 1) AS snapshot", "CASE order_id % 3 WHEN 1 THEN total ELSE total DIV 2 END AS had")
    return one.selectExpr("*", "issued AS snapshot", "total AS had").unionByName(later).withColumn("expires", F.expr("date_add(issued, CAST(20 + order_id % 5 * 10 AS INT))"))


@query(f"""WITH {_ORDERS}, t AS (SELECT market, item, snapshot, lag(snapshot) OVER (PARTITION BY market, item ORDER BY snapshot) AS previous FROM (SELECT DISTINCT market, item, snapshot FROM b))
 SELECT * FROM t WHERE previous IS NOT NULL""")
def J12_snapshot_pairs(spark, d):
    return P.snapshot_pairs(_orders(spark, d), ["market", "item"], "snapshot")


@query(f"""WITH {_ORDERS}, t AS (SELECT * FROM (SELECT market, item, snapshot, lag(snapshot) OVER (PARTITION BY market, item ORDER BY snapshot) AS previous FROM (SELECT DISTINCT market, item, snapshot FROM b)) WHERE previous IS NOT NULL),
 a AS (SELECT t.market, t.item, t.snapshot, b.order_id, b.price, b.had, b.issued + INTERVAL 1 DAY * (20 + b.order_id % 5 * 10) AS ends FROM t JOIN b ON t.market = b.market AND t.item = b.item AND t.previous = b.snapshot),
 n AS (SELECT b.* FROM t JOIN b USING (market, item, snapshot)), j AS (SELECT a.*, n.had AS has FROM a LEFT JOIN n USING (market, item, snapshot, order_id)),
 e AS (SELECT market, item, snapshot, max(price) AS edge FROM j WHERE has < had GROUP BY 1, 2, 3), c AS (SELECT market, item, snapshot, min(price) AS cheapest FROM n GROUP BY 1, 2, 3),
 f AS (SELECT j.*, CASE WHEN has < had THEN had - has WHEN has IS NULL AND ends > snapshot AND price <= coalesce(edge, cheapest, CAST('inf' AS DOUBLE)) THEN had ELSE 0 END AS filled FROM j LEFT JOIN e USING (market, item, snapshot) LEFT JOIN c USING (market, item, snapshot)),
 g AS (SELECT market, item, snapshot, sum(filled) AS q, sum(filled * price) AS v FROM f GROUP BY 1, 2, 3), w AS (SELECT market, item, snapshot, sum(price * total) AS v FROM n ANTI JOIN a USING (market, item, snapshot, order_id) GROUP BY 1, 2, 3)
 SELECT market, item, snapshot, CAST(coalesce(q, 0) AS BIGINT) AS fill_qty, round(coalesce(g.v, 0), 2) AS fill_value, round(coalesce(w.v, 0), 2) AS new_value FROM t LEFT JOIN g USING (market, item, snapshot) LEFT JOIN w USING (market, item, snapshot)""")
def A09_infer_fills(spark, d):
    return _rounded(P.infer_fills(_orders(spark, d), ["market", "item"], "snapshot", "order_id", "price", "had", "total", "expires"), fill_value=2, new_value=2)


_CAP, _VALUE = 0.12, 1000


def _basket_sql(name: str, year: int) -> str:
    """CTEs of the basket of a year: months m, cells k, capped shares by places, weights."""
    over = "(PARTITION BY market ORDER BY expenditure DESC, item)"
    return f"""{name}k AS (SELECT * FROM (SELECT market, item, count(*) AS days, CAST(sum(CAST(round(price * 1000) AS BIGINT) * volume) AS BIGINT) AS expenditure, median(price) FILTER (month(month) >= 10) AS base_price FROM m WHERE year(month) = {year} GROUP BY 1, 2) WHERE days >= 6 AND base_price IS NOT NULL AND expenditure > 0),
 {name}r AS (SELECT *, row_number() OVER {over} AS i, count(*) OVER (PARTITION BY market) AS n, sum(expenditure) OVER (PARTITION BY market) AS spent, sum(expenditure) OVER () AS world, sum(expenditure) OVER (PARTITION BY market ORDER BY expenditure DESC, item ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}k),
 {name}f AS (SELECT *, min(CASE WHEN expenditure * (1 - (i - 1) * {_CAP}) <= {_CAP} * rest THEN i END) OVER (PARTITION BY market) AS first FROM {name}r),
 {name}s AS (SELECT *, CASE WHEN n * {_CAP} <= 1 THEN 1 / n WHEN i < first THEN {_CAP} ELSE expenditure * (1 - (first - 1) * {_CAP}) / max(CASE WHEN i = first THEN rest END) OVER (PARTITION BY market) END AS share FROM {name}f),
 {name} AS (SELECT market, item, item % 3 AS division, CAST(share * spent / world AS DOUBLE) AS weight, share, base_price, expenditure FROM {name}s)"""


_MONTHS = f"{_listing_sql(10)}, m AS (SELECT market, item, month, median(price) AS price, CAST(sum(volume) AS BIGINT) AS volume FROM l GROUP BY 1, 2, 3)"


def _months(spark, d):
    return _listings(spark, d, 10).groupBy(*_BOOK).agg(F.percentile("price", F.lit(0.5)).alias("price"), F.sum("volume").alias("volume"))


def _basket(spark, d, year):
    daily = _months(spark, d).filter(F.year("month") == year)
    return P.build_basket(daily, "market", "item", F.month("month") >= 10, 6, _CAP, _VALUE).withColumn("division", F.col("item") % 3)


@query(f"WITH {_MONTHS}, {_basket_sql('k', 1996)} SELECT market, item, expenditure, round(CAST(share AS DOUBLE), 6) AS share FROM k")
def A11_cap_weights(spark, d):
    cells = _months(spark, d).filter(F.year("month") == 1996).withColumn("_spent", (F.round(F.col("price") * 1000).cast("long") * F.col("volume")).cast("long"))
    late = F.count_if(F.month("month") >= 10)
    known = cells.groupBy("market", "item").agg(F.count(F.lit(1)).alias("days"), F.sum("_spent").alias("expenditure"), late.alias("late")).filter("days >= 6 AND late > 0 AND expenditure > 0")
    return _rounded(P.cap_weights(known, "market", "expenditure", _CAP, ["item"]).select("market", "item", "expenditure", "share"), share=6)


@query(f"WITH {_MONTHS}, {_basket_sql('k', 1996)} SELECT market, item, round(weight, 6) AS weight, base_price, expenditure, round(weight * {_VALUE} / base_price, 6) AS quantity, division FROM k")
def A10_build_basket(spark, d):
    return _rounded(_basket(spark, d, 1996), weight=6, quantity=6)


def _groups_sql(name: str, basket: str, prices: str) -> str:
    return f"""{name} AS (SELECT day, market, division, sum(weight) AS "full", coalesce(sum(weight) FILTER (price IS NOT NULL), 0) AS seen, coalesce(sum(weight * price / base_price), 0) AS moved, count(price) AS n_seen
 FROM {basket} CROSS JOIN (SELECT DISTINCT day FROM {prices}) LEFT JOIN {prices} USING (market, item, day) GROUP BY 1, 2, 3)"""


def _levels_sql(name: str, groups: str) -> str:
    return f"""{name} AS (SELECT coalesce(CAST(market AS VARCHAR), 'all') AS scope, coalesce(CAST(division AS VARCHAR), 'all') AS division, day, sum("full" * moved / seen) FILTER (seen * 2 >= "full") / nullif(sum("full") FILTER (seen * 2 >= "full"), 0) AS relative,
 round(least(1.0, sum(seen) / sum("full")), 9) AS coverage, CAST(sum(n_seen) AS BIGINT) AS n_items FROM {groups} GROUP BY day, GROUPING SETS ((market, division), (market), (division), ()))"""


# months without the cells that a rule of keys leaves out, so that some groups are seen in part only
_YEAR_SQL = "y AS (SELECT market, item, month AS day, price FROM m WHERE year(month) = 1997 AND (market + item * 3 + month(month)) % 4 <> 0)"


def _year(spark, d):
    return _months(spark, d).filter((F.year("month") == 1997) & ((F.col("market") + F.col("item") * 3 + F.month("month")) % 4 != 0)).select("market", "item", F.col("month").alias("day"), "price")


def _groups(spark, d):
    return P.group_relatives(_basket(spark, d, 1996), _year(spark, d), "market", "item", "division", "day")


@query(f"""WITH {_MONTHS}, {_basket_sql('k', 1996)}, {_YEAR_SQL}, {_groups_sql('g', 'k', 'y')} SELECT day, market, division, round("full", 6) AS "full", round(seen, 6) AS seen, round(moved, 6) AS moved, n_seen FROM g""")
def A12_group_relatives(spark, d):
    return _rounded(_groups(spark, d), full=6, seen=6, moved=6)


@query(f"WITH {_MONTHS}, {_basket_sql('k', 1996)}, {_YEAR_SQL}, {_groups_sql('g', 'k', 'y')}, {_levels_sql('v', 'g')} SELECT scope, division, day, round(relative, 6) AS relative, round(coverage, 6) AS coverage, n_items FROM v")
def A13_aggregate_levels(spark, d):
    return _rounded(P.aggregate(_groups(spark, d), "market", "division", "day"), relative=6, coverage=6)


_LINK_SQL = "b AS (SELECT market, item, DATE '1996-12-01' AS day, median(price) AS price FROM m WHERE year(month) = 1996 AND month(month) >= 10 GROUP BY 1, 2)"


@query(f"""WITH {_MONTHS}, {_basket_sql('k', 1996)}, {_basket_sql('z', 1995)}, {_YEAR_SQL}, {_LINK_SQL}, {_groups_sql('g', 'k', 'y')}, {_levels_sql('v', 'g')}, {_groups_sql('h', 'z', 'b')}, {_levels_sql('u', 'h')},
 j AS (SELECT v.*, u.relative AS link FROM v LEFT JOIN (SELECT * FROM u WHERE coverage >= 0.5) u ON v.scope = u.scope AND v.division = u.division)
 SELECT scope, division, day, round(coverage, 6) AS coverage, n_items, CASE WHEN relative IS NULL OR link IS NULL OR coverage < 0.5 THEN 'insufficient' WHEN coverage < 0.9 THEN 'partial' ELSE 'ok' END AS status,
 CASE WHEN relative IS NOT NULL AND coverage >= 0.5 THEN round(link * relative, 6) END AS value FROM j""")
def W18_index_values(spark, d):
    window = _months(spark, d).filter((F.year("month") == 1996) & (F.month("month") >= 10)).groupBy("market", "item").agg(F.percentile("price", F.lit(0.5)).alias("price"))
    known = window.withColumn("day", F.lit("1996-12-01").cast("date"))
    links = P.link_factors(P.aggregate(P.group_relatives(_basket(spark, d, 1995), known, "market", "item", "division", "day"), "market", "division", "day"))
    return _rounded(P.index_values(P.aggregate(_groups(spark, d), "market", "division", "day"), links), coverage=6)


def _daily(spark, d):
    """Months of every market and item: median price, volume, diagnostics of the book."""
    books = P.snapshot_prices(_listings(spark, d, 50), _BOOK, "price", 3)
    sold = _listings(spark, d, 50).groupBy(*_BOOK).agg(F.sum(F.when(F.col("volume") > 30, F.col("volume")).otherwise(0)).alias("sold"))
    return books.join(sold, _BOOK).withColumn("price", F.coalesce("price", "min_price"))


@query(f"""WITH {_snapshot_sql(50)}, v AS (SELECT market, item, month, CAST(sum(CASE WHEN volume > 30 THEN volume ELSE 0 END) AS BIGINT) AS sold FROM l GROUP BY 1, 2, 3), y AS (SELECT s.market, s.item, s.month, coalesce(price, min_price) AS price, sold FROM s JOIN v USING (market, item, month)),
 c AS (SELECT item, month, count(*) AS n_traded, median(ln(price)) AS x FROM y WHERE sold > 0 GROUP BY 1, 2) SELECT market, item, month, price, sold, sold > 0 AS paid, coalesce(n_traded, 0) AS n_traded, round(x, 6) AS cross_log FROM y LEFT JOIN c USING (item, month)""")
def W11_consensus(spark, d):
    return _rounded(P.consensus(_daily(spark, d), "item", "month", "price", "sold").select("market", "item", "month", "price", "sold", "paid", "n_traded", "cross_log"), cross_log=6)


@query(None)
def W11_accept_daily(spark, d):
    """No SQL: each day's verdict depends on the verdicts before it."""
    return P.accept_daily(_daily(spark, d), "market", "item", "month", "price", "sold").select("market", "item", "month", "price", "reason", "accepted")


@query(f"""WITH {_snapshot_sql(50)}, v AS (SELECT market, item, month, CAST(sum(CASE WHEN volume > 30 THEN volume ELSE 0 END) AS BIGINT) AS sold FROM l GROUP BY 1, 2, 3), y AS (SELECT s.* REPLACE (coalesce(price, min_price) AS price), sold FROM s JOIN v USING (market, item, month)),
 c AS (SELECT item, month, count(*) AS n_traded, median(ln(price)) AS x FROM y WHERE sold > 0 GROUP BY 1, 2), e AS (SELECT y.*, n_traded >= 3 AND abs(ln(price) - x) > 0.3 AS refused, abs(ln(price) - x) / 0.3 AS distance FROM y LEFT JOIN c USING (item, month)),
 w AS (SELECT *, CASE WHEN count(*) OVER b >= 5 THEN median(ln(price)) OVER b END AS ref FROM e WINDOW b AS (PARTITION BY market, item ORDER BY month ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
 SELECT market, item, month, 'extreme_listing' AS kind, round(max_z, 5) AS severity, n AS depth, n < 10 AS thin FROM w WHERE n_extreme > 0 UNION ALL SELECT market, item, month, 'rejected_price', round(distance, 5), n, n < 10 FROM w WHERE refused
 UNION ALL SELECT market, item, month, 'thin_market_spike', round(abs(ln(price) - ref) / ln(1.75), 5), n, true FROM w WHERE n < 10 AND abs(ln(price) - ref) >= ln(1.75)""")
def W10_manipulation_events(spark, d):
    off = F.abs(F.ln("price") - F.col("cross_log"))
    daily = P.consensus(_daily(spark, d), "item", "month", "price", "sold").withColumn("reason", F.when((F.col("n_traded") >= 3) & (off > 0.3), "cross_market")).withColumn("distance", off / 0.3)
    return _rounded(P.manipulation_events(daily.withColumnRenamed("n", "max_listings"), ["market", "item"], "month"), severity=5)


_RELEASES = "r AS (SELECT event_id, ts - INTERVAL 9000 DAY AS released, [['1-URGENT', '2-HIGH', '3-MEDIUM'][1 + user_id % 3], ['4-NOT SPECIFIED', '5-LOW'][1 + user_id % 2]] AS topics, value > 50 AS major FROM events WHERE event_type = 'error')"
_SERIES = "v AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS total FROM orders GROUP BY 1, 2)"


def _releases(spark, d):
    topics = "array(element_at(array('1-URGENT', '2-HIGH', '3-MEDIUM'), CAST(1 + user_id % 3 AS INT)), element_at(array('4-NOT SPECIFIED', '5-LOW'), CAST(1 + user_id % 2 AS INT))) AS topics"
    return _t(spark, d, "events").filter("event_type = 'error'").selectExpr("event_id", "ts - INTERVAL 9000 DAY AS released", topics, "value > 50 AS major")


def _series(spark, d):
    return _t(spark, d, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double").alias("total"))


@query(f"""WITH {_RELEASES}, {_SERIES}, s AS (SELECT CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_orderpriority END AS topic, day FROM v WHERE total > 40000000),
 p AS (SELECT s.*, r.*, greatest(0, (epoch_us(CAST(day AS TIMESTAMP)) + 43200000000 - epoch_us(released)) / 3600000000) AS lag, list_position(topics, topic) AS pos FROM s JOIN r ON CAST(released AS DATE) BETWEEN day - 3 AND day),
 w AS (SELECT *, CASE WHEN topic IS NULL AND len(topics) > 0 THEN 0.8 WHEN pos > 0 THEN 1 / pos WHEN major THEN 0.5 ELSE 0.15 END * exp(-lag / 48) AS rel FROM p)
 SELECT topic, day, event_id, round(lag, 2) AS lag_hours, round(least(1.0, rel), 4) AS relevance, CAST(row_number() OVER (PARTITION BY topic, day ORDER BY round(rel, 9) DESC, lag, event_id) AS INT) AS rank FROM w""")
def J09_attribute(spark, d):
    shocks = _series(spark, d).filter("total > 40000000").select(F.expr("CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_orderpriority END").alias("topic"), "day")
    return P.attribute(shocks, _releases(spark, d), "day", "topic", "released", "event_id", "topics", "major", 3)


@query(f"""WITH {_RELEASES}, {_SERIES}, l AS (SELECT *, CASE WHEN count(*) OVER a >= 4 THEN median(ln(total)) OVER a END AS after, CASE WHEN count(*) OVER b >= 4 THEN median(ln(total)) OVER b END AS before FROM v
 WINDOW a AS (PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING), b AS (PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
 g AS (SELECT *, after - before AS chg FROM l WHERE after - before IS NOT NULL), m AS (SELECT o_orderpriority, median(chg) AS mid, mad(chg) AS mad FROM g GROUP BY 1)
 SELECT event_id, o_orderpriority, round(chg, 5) AS log_change, round((chg - mid) / greatest(mad * 1.4826, 1e-4), 4) AS robust_z FROM r JOIN g ON g.day = CAST(released AS DATE) JOIN m USING (o_orderpriority)""")
def W08_release_impact(spark, d):
    releases = _releases(spark, d).select("event_id", F.to_date("released").alias("day"))
    return _rounded(P.release_impact(_series(spark, d), ["o_orderpriority"], "day", "total", releases, "event_id"), log_change=5, robust_z=4)
