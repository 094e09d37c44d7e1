"""Queries of the daily series, experiments and vintages, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indexes as I
from .tables import _t, query

_DAILY = "daily AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2)"


def _daily(spark, d):
    return _t(spark, d, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))


_SHOCKS = f"""WITH {_DAILY}, k AS (SELECT *, count(n) OVER w AS c, median(n) OVER w AS median, stddev_pop(n) OVER w AS sd FROM daily
 WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
 s AS (SELECT o_orderpriority, day, n, median, CASE WHEN c >= 20 AND sd > 0 THEN round((n - median) / sd, 6) END AS score FROM k), hits AS (SELECT * FROM s WHERE abs(score) >= 2)"""


@query(f"{_SHOCKS} SELECT * FROM hits")
def W06_detect_shocks(spark, d):
    return I.shocks(_daily(spark, d), ["o_orderpriority"], "day", "n", 60, 20, 2.0)


@query(f"""{_SHOCKS}, f AS (SELECT *, CASE WHEN day - lag(day) OVER w <= 1 AND sign(score) = sign(lag(score) OVER w) THEN 0 ELSE 1 END AS fresh FROM hits WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day)),
 r AS (SELECT *, sum(fresh) OVER (PARTITION BY o_orderpriority ORDER BY day) AS run FROM f)
 SELECT o_orderpriority, min(day) AS first_day, max(day) AS last_day, count(*) AS days, max(abs(score)) AS largest FROM r GROUP BY o_orderpriority, run""")
def W07_merge_runs(spark, d):
    return I.merge_runs(W06_detect_shocks(spark, d), ["o_orderpriority"], "day", "score")


@query(f"""WITH {_DAILY} SELECT a.o_orderpriority, a.day, w.days, round(a.n / b.n - 1, 6) AS change FROM daily a, (VALUES (7), (30), (90), (365)) w(days), daily b
 WHERE a.o_orderpriority = b.o_orderpriority AND a.day = b.day + w.days""")
def W19_inflation(spark, d):
    return I.changes(_daily(spark, d), ["o_orderpriority"], "day", "n", [7, 30, 90, 365])


@query("""WITH m AS (SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1, 2),
 l AS (SELECT o_orderpriority, month, n / lag(n) OVER (PARTITION BY o_orderpriority ORDER BY month) AS factor FROM m)
 SELECT o_orderpriority, month, round(factor, 6) AS factor, round(exp(sum(ln(factor)) OVER (PARTITION BY o_orderpriority ORDER BY month)), 6) AS level FROM l WHERE factor IS NOT NULL""")
def W17_chain_links(spark, d):
    from pyspark.sql import Window

    months = _t(spark, d, "orders").groupBy("o_orderpriority", F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"))
    factor = F.col("n") / F.lag("n").over(Window.partitionBy("o_orderpriority").orderBy("month"))
    links = months.select("o_orderpriority", "month", factor.alias("factor")).filter("factor is not null")
    return I.chain(links, ["o_orderpriority"], "month", "factor").withColumn("factor", F.round("factor", 6))


@query("SELECT user_id, ts, event_id, event_type FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def W15_as_of_vintage(spark, d):
    versions = _t(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return I.as_of_vintage(versions, ["user_id"], "ts", "event_id", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


@query("""WITH v AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER w AS previous, row_number() OVER w = 1 AS initial FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
 SELECT user_id, ts, event_id, event_type, previous, CASE WHEN initial THEN 'initial' ELSE 'revision' END AS reason FROM v WHERE initial OR previous IS DISTINCT FROM event_type""")
def W16_publish_vintage(spark, d):
    return I.revisions(_t(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")


@query("SELECT o_orderkey, CASE WHEN CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20 THEN 'test' ELSE 'train' END AS split FROM orders")
def W24_assign_split(spark, d):
    return I.hashed_split(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 20)


_TREATED, _OUTCOME, _SCORE = "o_orderkey % 3 <> 0", "o_totalprice > 150000", "(o_orderkey * 31 % 1009) / 1009.0"
_BINS = f"""b AS (SELECT CAST(least(floor({_SCORE} * 10), 9) AS BIGINT) AS bin, count(*) FILTER ({_TREATED}) AS n_treated, count(*) FILTER (NOT ({_TREATED})) AS n_control,
 count(*) FILTER ({_TREATED} AND {_OUTCOME}) AS k_treated, count(*) FILTER (NOT ({_TREATED}) AND {_OUTCOME}) AS k_control FROM orders GROUP BY 1)"""


def _score():
    return F.col("o_orderkey") * 31 % 1009 / F.lit(1009.0)


@query(f"WITH {_BINS} SELECT *, round(k_treated / nullif(n_treated, 0) - k_control / nullif(n_control, 0), 6) AS uplift FROM b")
def W22_deciles(spark, d):
    return I.uplift_bins(_t(spark, d, "orders"), _score(), 10, F.expr(_TREATED), F.expr(_OUTCOME))


@query(f"""WITH {_BINS} SELECT bin, CAST(sum(n_treated) OVER w AS BIGINT) AS treated_so_far,
 round(sum(k_treated) OVER w - sum(k_control) OVER w * (sum(n_treated) OVER w / nullif(sum(n_control) OVER w, 0)), 6) AS qini FROM b WINDOW w AS (ORDER BY bin DESC)""")
def W20_qini_curve(spark, d):
    return I.qini(W22_deciles(spark, d))


_P = "(o_orderkey * 7919 % 99991) / 99991.0"


@query(f"""WITH t AS (SELECT o_custkey, o_orderkey, {_P} AS p FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY p, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS m FROM t)
 SELECT o_custkey, o_orderkey, p, round(least(1.0, min(p * m / k) OVER (PARTITION BY o_custkey ORDER BY k DESC)), 6) AS adjusted FROM r""")
def W23_benjamini_hochberg(spark, d):
    """A family of tests for each customer; the p-values are derived from the order keys."""
    tests = _t(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") * 7919 % 99991 / F.lit(99991.0)).alias("p"))
    return I.benjamini_hochberg(tests, ["o_custkey"], "p", "o_orderkey")


@query(f"SELECT c_mktsegment, count(*) FILTER ({_TREATED}) AS n_treated, count(*) FILTER (NOT ({_TREATED})) AS n_control, round(avg(CAST({_OUTCOME} AS INT)) FILTER ({_TREATED}), 4) AS mean_treated, round(avg(CAST({_OUTCOME} AS INT)) FILTER (NOT ({_TREATED})), 4) AS mean_control,"
       f" CASE WHEN count(*) FILTER ({_TREATED}) >= 30 AND count(*) FILTER (NOT ({_TREATED})) >= 30 THEN CASE WHEN avg(CAST({_OUTCOME} AS INT)) FILTER ({_TREATED}) > avg(CAST({_OUTCOME} AS INT)) FILTER (NOT ({_TREATED})) THEN 'treat' ELSE 'leave' END END AS choice FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")  # fmt: skip
def M05_policy_profit(spark, d):
    units = _t(spark, d, "orders").join(_t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return I.policy_profit(units, "c_mktsegment", F.expr(_TREATED), F.expr(_OUTCOME).cast("int"), 30)


@query(f"""WITH u AS (SELECT {_TREATED} AS t, CAST({_OUTCOME} AS INT) AS y, o_orderpriority, o_orderstatus FROM orders),
 s AS (SELECT t, y, 'o_orderpriority' AS feature, o_orderpriority AS value FROM u UNION ALL SELECT t, y, 'o_orderstatus', o_orderstatus FROM u UNION ALL SELECT t, y, 'o_orderpriority+o_orderstatus', o_orderpriority || '+' || o_orderstatus FROM u)
 SELECT feature, value, count(*) AS n, round(avg(y) FILTER (t) - avg(y) FILTER (NOT t), 6) AS uplift FROM s GROUP BY 1, 2""")
def M06_segment_scan(spark, d):
    return I.segment_scan(_t(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], F.expr(_TREATED), F.expr(_OUTCOME))


@query(f"SELECT CAST(least(floor({_SCORE} * 20), 19) AS BIGINT) AS bin, count(*) AS n, round(avg({_SCORE}), 6) AS mean_score, round(avg(CAST({_OUTCOME} AS INT)), 6) AS hit_rate FROM orders GROUP BY 1")
def M18_reliability_bins(spark, d):
    return I.reliability(_t(spark, d, "orders"), _score(), F.expr(_OUTCOME), 20)


_GOAL = "o_totalprice > 90000"


@query(f"""WITH u AS (SELECT o_orderpriority, {_GOAL} AS g, {_TREATED} AS t, CAST({_OUTCOME} AS INT) AS y FROM orders), s AS (SELECT o_orderpriority, avg(CAST(g AS INT)) AS f, count(*) FILTER (g AND t) AS n1, avg(y) FILTER (g AND t) AS m1, count(*) FILTER (NOT g AND NOT t) AS n2, avg(y) FILTER (NOT g AND NOT t) AS m2,
 count(*) FILTER (t) AS n3, avg(y) FILTER (t) AS m3, count(*) FILTER (NOT t) AS n4, avg(y) FILTER (NOT t) AS m4 FROM u GROUP BY 1), e AS (SELECT *, n3 >= 30 AND n4 >= 30 AND (f = 0 OR n1 >= 30) AND (f = 1 OR n2 >= 30) AS ok FROM s)
 SELECT o_orderpriority, round(f, 6) AS share, CASE WHEN ok THEN round(20.0 * (coalesce(f * m1, 0) + coalesce((1 - f) * m2, 0)) - 3.0 * f, 6) END AS policy, CASE WHEN ok THEN round(20.0 * m3 - 3.0, 6) END AS treat_all, CASE WHEN ok THEN round(20.0 * m4, 6) END AS treat_none FROM e""")
def M05_profits(spark, d):
    """Dear orders are targeted; profit of that policy, of treating all and of treating none, by priority."""
    told = I.profits(_t(spark, d, "orders"), ["o_orderpriority"], F.expr(_GOAL), F.expr(_TREATED), F.expr(_OUTCOME), 20.0, 3.0, 30)
    return told.select("o_orderpriority", *(F.round(n, 6).alias(n) for n in ("share", "policy", "treat_all", "treat_none")))
