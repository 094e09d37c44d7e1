"""Queries of fitted models over the given tables. Where SQL can express a part of one, it stands beside it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import learners as L
from ..operators import reports as R
from .tables import _t, query


def _units(spark, d):
    orders = _t(spark, d, "orders").join(_t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_nationkey"), "o_custkey")
    return orders.select("o_orderkey", "o_orderpriority", "o_orderstatus", F.col("c_acctbal"), F.col("c_nationkey").cast("double").alias("nation"), F.month("o_orderdate").cast("double").alias("month"), (F.col("o_orderkey") % 3 != 0).alias("treated"), (F.col("o_totalprice") > 150000).alias("outcome"))


def _learn(spark, d, kind):
    units = _units(spark, d)
    return L.fit_learner(kind, units.filter("o_orderkey % 5 <> 0"), ["c_acctbal", "nation", "month"], "treated", "outcome", "o_orderkey")(units.filter("o_orderkey % 5 = 0"))


@query(None)
def M02_x_learner(spark, d):
    """No SQL: fitted trees. Scores of the units that the learner didn't see; tests hold all learners against a planted effect."""
    return _learn(spark, d, "x").select("o_orderkey", "score")


@query(None)
def M08_evaluate_learners(spark, d):
    """No SQL: fitted trees."""
    scores = [_learn(spark, d, kind).select(F.lit(kind).alias("learner"), "o_orderkey", "score", "treated", "outcome") for kind in ("random", "response", "t")]
    return L.evaluate_learners(reduce(lambda a, b: a.unionByName(b), scores), "learner", "score", "o_orderkey", F.col("treated"), F.col("outcome"))


_SCORED = "u AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_orderkey * 31 % 1009 / 1009.0 - 0.1 AS score FROM orders), p AS (SELECT *, row_number() OVER (ORDER BY score DESC, o_orderkey) AS place, count(*) OVER () AS n FROM u)"


@query(f"""WITH {_SCORED}, d AS (SELECT 'top' AS part, * FROM p WHERE place * 10 <= n UNION ALL SELECT 'harmed', * FROM p WHERE score < 0), v AS (SELECT part, 'o_orderpriority' AS column_name, o_orderpriority AS value FROM d UNION ALL SELECT part, 'o_orderstatus', o_orderstatus FROM d)
 SELECT part, column_name, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY part, column_name), 6) AS share FROM v GROUP BY 1, 2, 3""")
def M07_group_profile(spark, d):
    units = _t(spark, d, "orders").selectExpr("o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderkey * 31 % 1009 / 1009.0D - 0.1D AS score")
    return L.group_profile(units, "score", "o_orderkey", ["o_orderpriority", "o_orderstatus"]).withColumn("share", F.round("share", 6))


@query("""WITH s AS (SELECT CAST(floor(o_orderkey * 31 % 1009 / 1009.0::DOUBLE * 100) AS INT) AS step, o_totalprice > 150000 - 60000 * (o_orderkey * 31 % 1009 / 1009.0::DOUBLE) AS y FROM orders), g AS (SELECT step, count(*) AS n, count(*) FILTER (y) AS k FROM s GROUP BY 1)
 SELECT step / 100 AS threshold, round(2 * sum(k) OVER (ORDER BY step DESC) / (sum(n) OVER (ORDER BY step DESC) + sum(k) OVER ()), 9) AS f1 FROM g ORDER BY f1 DESC, threshold LIMIT 1""")
def M14_best_threshold(spark, d):
    p = "o_orderkey * 31 % 1009 / 1009.0D"
    scores = _t(spark, d, "orders").selectExpr(f"{p} AS p", f"o_totalprice > 150000 - 60000 * ({p}) AS y")
    return L.best_threshold(scores, "p", F.col("y")).withColumn("f1", F.round("f1", 9))


@query(None)
def M14_calibrate(spark, d):
    """No SQL: a fitted regression for each depth."""
    p = "o_orderkey * 31 % 1009 / 1009.0D"
    return L.calibrate(_t(spark, d, "orders").selectExpr("o_orderkey % 3 + 1 AS depth", f"{p} AS p", f"o_totalprice > 300000 * (1 - ({p})) AS y"), "depth", "p", "y")


@query(None)
def M16_select_batch(spark, d):
    """No SQL: clusters. The batch is the feature: 20 items."""
    vectors = _t(spark, d, "embeddings").select("vec_id", "embedding")
    return L.select_batch(vectors.selectExpr("vec_id", "vec_id * 31 % 101 / 101.0D AS score"), vectors, "vec_id", "score", "embedding", 20)


@query(None)
def M21_kmeans(spark, d):
    """No SQL: iterated centres."""
    return L.kmeans(_t(spark, d, "embeddings"), "vec_id", "embedding", 8)


@query(None)
def M24_projection_quality(spark, d):
    """No SQL: principal axes. For each vector the share of its ten neighbours that the plane keeps; all are asked."""
    from ..operators.measures import knn

    vectors = _t(spark, d, "embeddings")
    flat, _ = L.pca2(vectors, "vec_id", "embedding")
    high = knn(vectors.select("vec_id", "embedding"), vectors.select("vec_id", "embedding"), "vec_id", "embedding", 10)
    return R.neighbour_recall(high, R.knn_2d(flat, flat, "vec_id", "x", "y", 10), vectors, "vec_id", "label")
