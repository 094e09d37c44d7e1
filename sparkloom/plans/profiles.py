"""Queries of the profiles and summaries, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles as P
from .tables import _t, query

_DAYS = "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)"


def _days(spark, d):
    return _t(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query(f"""{_DAYS}, m AS (SELECT user_id, month(day) AS busiest_month FROM d GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sum(n) DESC, month(day)) = 1),
 b AS (SELECT user_id, day AS busiest_day FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, day) = 1)
 SELECT user_id, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS n_days, CASE WHEN sum(n) >= 20 THEN round(coalesce(sum(n) FILTER (dayofweek(day) IN (0, 6)), 0) / sum(n), 6) END AS weekend_share,
 any_value(busiest_day) AS busiest_day, any_value(busiest_month) AS busiest_month FROM d JOIN m USING (user_id) JOIN b USING (user_id) GROUP BY 1""")
def A03_user_year(spark, d):
    return P.user_year(_days(spark, d), "user_id", "day", "n", 20)


@query(f"{_DAYS} SELECT count(DISTINCT user_id) AS users, CAST(sum(n) AS BIGINT) AS n_events, count(*) AS user_days FROM d")
def A04_population(spark, d):
    users = _days(spark, d).groupBy("user_id").agg(F.sum("n").alias("n"), F.count("*").alias("days"))
    return users.agg(F.count("*").alias("users"), F.sum("n").alias("n_events"), F.sum("days").alias("user_days"))


_BOOKS = "SELECT l_suppkey % 4 AS server, l_partkey % 50 AS item, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_extendedprice, l_orderkey, l_linenumber FROM lineitem"


@query(f"""WITH l AS ({_BOOKS}), r AS (SELECT *, row_number() OVER (PARTITION BY server, item, month ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS place, count(*) OVER (PARTITION BY server, item, month) AS n FROM l)
 SELECT server, item, month, any_value(n) AS n, max(l_extendedprice) FILTER (place = greatest(1, (n - 1) // 4) + 1) AS quartile, median(l_extendedprice) AS median FROM r GROUP BY 1, 2, 3 HAVING any_value(n) >= 3""")
def A06_book_price(spark, d):
    listings = _t(spark, d, "lineitem").select((F.col("l_suppkey") % 4).alias("server"), (F.col("l_partkey") % 50).alias("item"), F.trunc("l_shipdate", "month").alias("month"), "l_extendedprice", "l_orderkey", "l_linenumber")
    return P.book_price(listings, ["server", "item", "month"], "l_extendedprice", ["l_orderkey", "l_linenumber"], 3)


@query("""SELECT l_suppkey % 4 AS server, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume,
 round(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / sum(CAST(l_quantity AS BIGINT)), 6) AS vwap FROM lineitem GROUP BY 1, 2""")
def A08_daily_volume(spark, d):
    fills = _t(spark, d, "lineitem").select((F.col("l_suppkey") % 4).alias("server"), F.to_date("l_shipdate").alias("day"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("quantity"))
    return P.daily_volume(fills, ["server", "day"], "cents", "quantity")


@query("SELECT user_id, event_type AS metric, count(*) AS n FROM events WHERE event_type IN ('view', 'purchase', 'error') GROUP BY 1, 2")
def A15_unpivot_metrics(spark, d):
    kinds = ["view", "purchase", "error"]
    wide = _t(spark, d, "events").groupBy("user_id").agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))
    return P.metrics_long(wide, "user_id", kinds)


@query("""SELECT user_id, CAST(sum(CAST(floor(value) AS BIGINT)) FILTER (event_id % 97 <> 0) AS BIGINT) AS stored, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS replayed
 FROM events GROUP BY 1 HAVING stored IS DISTINCT FROM replayed""")
def A19_snapshot_drift(spark, d):
    deltas = _t(spark, d, "events").select("event_id", "user_id", F.floor("value").alias("delta"))
    snapshot = deltas.filter("event_id % 97 <> 0").groupBy("user_id").agg(F.sum("delta").alias("level"))
    return P.drift(snapshot, deltas, "user_id", "level", "delta")


@query("""SELECT user_id, count(*) AS n, min(value) AS least, max(value) AS greatest, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(stddev_samp(value) / nullif(avg(value), 0), 6) AS cv,
 bool_and(event_type <> 'error') AS all_ok, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'error') AS last_error FROM events GROUP BY 1""")
def A22_summarise_runs(spark, d):
    return P.summarise_runs(_t(spark, d, "events"), "user_id", "value", F.col("event_type") != "error", ["ts", "event_id"], "event_id")


@query("SELECT count(*) AS n, bit_xor(h) AS xor, CAST(sum(h) AS BIGINT) AS total FROM (SELECT CAST('0x' || substr(md5(coalesce(length(CAST(o_orderkey AS VARCHAR)) || ':' || o_orderkey, '-') || coalesce(length(CAST(o_custkey AS VARCHAR)) || ':' || o_custkey, '-') || coalesce(length(o_orderstatus) || ':' || o_orderstatus, '-')), 1, 8) AS BIGINT) AS h FROM orders)")
def A28_fingerprint(spark, d):
    return P.fingerprint(_t(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus"])


@query("""WITH s AS (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS all_n FROM documents WHERE n_chars > 1000 GROUP BY 1), e AS (SELECT lang, count(*) AS m, sum(count(*)) OVER () AS all_m FROM documents GROUP BY 1)
 SELECT s.lang, n, round(n / all_n, 6) AS share, round((n / all_n) / (m / all_m), 6) AS lift FROM s JOIN e ON s.lang IS NOT DISTINCT FROM e.lang""")
def A29_category_summary(spark, d):
    docs = _t(spark, d, "documents").select("lang", "n_chars")
    return P.category_summary(docs.filter("n_chars > 1000"), docs, "lang")


@query("SELECT source, count(n_chars) AS n, min(n_chars) AS least, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS median, quantile_cont(n_chars, 0.75) AS q3, max(n_chars) AS greatest, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1")
def A30_rank_summary(spark, d):
    return P.rank_summary(_t(spark, d, "documents"), "source", "n_chars")


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, round(count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type = 'view'), 0), 4) AS rate FROM events GROUP BY 1")
def A32_share_rate(spark, d):
    kind = F.col("event_type")
    sums = _t(spark, d, "events").groupBy("user_id").agg(F.count_if(kind == "view").alias("views"), F.count_if(kind == "click").alias("clicks"))
    return sums.withColumn("rate", F.round(F.try_divide("clicks", "views"), 4))


@query("""SELECT CAST(l_shipdate AS DATE) AS day, 'sink' AS kind, CAST(sum(CAST(round(l_extendedprice * l_tax * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1
 UNION ALL SELECT CAST(l_shipdate AS DATE), 'faucet', CAST(sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) AS BIGINT) FROM lineitem GROUP BY 1""")
def A34_money_flows(spark, d):
    """Both kinds from one scan and one shuffle, then two rows for each day."""
    cents = lambda rate: F.sum(F.round(F.col("l_extendedprice") * F.col(rate) * 100).cast("long"))
    wide = _t(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(cents("l_tax").alias("sink"), cents("l_discount").alias("faucet"))
    return wide.unpivot("day", ["sink", "faucet"], "kind", "cents")


@query("""WITH b AS (SELECT p_size, max(p_retailprice) AS p_retailprice FROM part GROUP BY 1)
 SELECT * FROM b a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.p_size < a.p_size AND b.p_retailprice >= a.p_retailprice)""")
def A37_pareto(spark, d):
    return P.pareto(_t(spark, d, "part"), "p_size", "p_retailprice")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events)
 SELECT user_id, count(*) AS n, round(avg(CAST(event_type = 'error' AS INT)), 6) AS hit_rate, count(*) FILTER (place <= 20 AND event_type = 'error') AS recent_hits FROM r GROUP BY 1""")
def A39_property_history(spark, d):
    return P.recent_record(_t(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], F.col("event_type") == "error", 20)


@query("""WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic <> 1 AND quality = 0) AS fp, count(*) FILTER (toxic = 1 AND quality <> 0) AS fn, count(*) FILTER (toxic <> 1 AND quality <> 0) AS tn FROM labels)
 SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""")
def A40_confusion(spark, d):
    return P.confusion(_t(spark, d, "labels"), F.col("toxic") == 1, F.col("quality") == 0)


@query("SELECT r_name, n_name, c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS flagged FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def A42_node_label_counts(spark, d):
    # nation and region are fixed lists
    tree = _t(spark, d, "nation").join(F.broadcast(_t(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    paths = _t(spark, d, "customer").join(F.broadcast(tree), F.col("c_nationkey") == F.col("n_nationkey"))
    return P.node_counts(paths, ["r_name", "n_name", "c_mktsegment"], F.col("c_acctbal") < 0)


@query("""WITH g AS (SELECT event_type, max(ts) AS newest FROM events GROUP BY 1), n AS (SELECT max(newest) AS now FROM g)
 SELECT event_type, newest, epoch_us(now) - epoch_us(newest) AS age_us, epoch_us(now) - epoch_us(newest) > 600000000 AS stale FROM g, n""")
def A47_freshness(spark, d):
    return P.freshness(_t(spark, d, "events"), "event_type", "ts", 600)


@query("WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT count(*) AS n_keys, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.9) AS p90, quantile_disc(n, 0.99) AS p99, max(n) AS most FROM c")
def A49_skew_profile(spark, d):
    return P.skew_profile(_t(spark, d, "orders"), "o_custkey")


@query("""WITH l AS (SELECT user_id, max(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - epoch_us(ts) AS late FROM events)
 SELECT user_id, count(*) AS n, count(*) FILTER (late > 0) AS out_of_order, greatest(0, coalesce(max(late), 0)) AS worst_us FROM l GROUP BY 1""")
def A50_arrival_profile(spark, d):
    return P.arrival_profile(_t(spark, d, "events"), "user_id", "event_id", "ts")
