"""Queries of claims, experiments, labels and joins over the given tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims as C
from .indexes import _OUTCOME, _SCORE, _TREATED, _score
from .tables import CUTS, _t, query

_LADDER = ", ".join(f"({x})" for x in CUTS)


@query(f"""WITH c(cut) AS (VALUES {_LADDER}), b AS (SELECT cut, (SELECT count(*) FROM lineitem WHERE l_extendedprice >= cut) AS at_or_above, lead(cut) OVER (ORDER BY cut) AS next FROM c)
 SELECT CAST(cut AS DOUBLE) AS cut, (SELECT count(*) FROM lineitem WHERE l_extendedprice >= cut AND (next IS NULL OR l_extendedprice < next)) AS n, at_or_above FROM b WHERE at_or_above >= 10""")
def A14_cutpoints(spark, d):
    return C.cutpoints(_t(spark, d, "lineitem"), "l_extendedprice", CUTS, 10)


def _balances(spark, d):
    """Each customer's exact standing by balance, ties sharing the last place."""
    from ..operators.ranks import running

    rows = running(_t(spark, d, "customer").select("c_custkey", "c_acctbal"), "sum", F.lit(1).cast("long"), "at_or_above", F.desc("c_acctbal"), ties=True)
    return rows.withColumn("population", F.lit(_t(spark, d, "customer").count()))


_STAND = "SELECT c_custkey, count(*) OVER (ORDER BY c_acctbal DESC RANGE UNBOUNDED PRECEDING) AS at_or_above, count(*) OVER () AS population FROM customer"
_RUNGS = "[1, 5, 10, 20, 30, 50, 100, 150, 200, 250]"


@query(f"SELECT c_custkey, at_or_above, list_min(list_filter({_RUNGS}, lambda r: at_or_above * 1000 <= population * r)) AS permille FROM ({_STAND})")
def F09_claim_permille(spark, d):
    return _balances(spark, d).select("c_custkey", "at_or_above", C.claim_permille(F.col("at_or_above"), F.col("population")).alias("permille"))


@query(f"""WITH e AS ({_STAND}), x AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 250 END AS permille FROM customer),
 m AS (SELECT *, list_min(list_filter({_RUNGS}, lambda r: at_or_above * 1000 <= population * r)) AS best FROM x JOIN e USING (c_custkey))
 SELECT c_custkey, 'false' AS violation FROM m WHERE at_or_above * 1000 > population * permille UNION ALL SELECT c_custkey, 'too_small' FROM m WHERE at_or_above < 10
 UNION ALL SELECT c_custkey, 'not_reproducible' FROM m WHERE best IS NULL OR best <> permille""")
def W14_audit_claims(spark, d):
    claims = _t(spark, d, "customer").selectExpr("c_custkey", "CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 250 END AS permille")
    return C.audit_claims(claims, _balances(spark, d), "c_custkey", 10)


@query("SELECT cut, n, CAST(sum(n) OVER (ORDER BY cut DESC) AS BIGINT) AS at_or_above FROM (SELECT CAST(floor(l_extendedprice / 1000) AS BIGINT) AS cut, count(*) AS n FROM lineitem GROUP BY 1)")
def W12_running_at_or_above(spark, d):
    from ..operators.series import standing

    counts = _t(spark, d, "lineitem").groupBy(F.floor(F.col("l_extendedprice") / 1000).alias("cut")).agg(F.count(F.lit(1)).alias("n"))
    return standing(counts, "cut", "n")


@query("""WITH h AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS i FROM events WHERE value IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM h WHERE i <= CASE event_type WHEN 'view' THEN 2 ELSE 1 END)
 SELECT user_id, event_id, event_type, count(*) OVER (PARTITION BY user_id) - r + 1 AS place FROM r WHERE r <= 4""")
def T03_select_story(spark, d):
    rows = _t(spark, d, "events").filter("value is not null")
    return C.select_story(rows, "user_id", "event_type", "value", "event_id", {"view": 2}, 4).select("user_id", "event_id", "event_type", "place")


_RANKED = f"r AS (SELECT *, row_number() OVER (ORDER BY {_SCORE} DESC, o_orderkey) AS place, count(*) OVER () AS n FROM orders)"
_ARMS = f"count(*) FILTER ({_TREATED}) AS n_treated, count(*) FILTER (NOT ({_TREATED})) AS n_control, count(*) FILTER ({_TREATED} AND {_OUTCOME}) AS k_treated, count(*) FILTER (NOT ({_TREATED}) AND {_OUTCOME}) AS k_control"
_ERR = "1.96 * sqrt(p * (1 - p) / n_treated + q * (1 - q) / n_control)"


@query(f"""WITH {_RANKED}, b AS (SELECT CAST(floor((place - 1) * 10 / n) + 1 AS BIGINT) AS bin, {_ARMS} FROM r GROUP BY 1), p AS (SELECT *, k_treated / nullif(n_treated, 0) AS p, k_control / nullif(n_control, 0) AS q FROM b)
 SELECT bin, n_treated, n_control, k_treated, k_control, round(p - q, 6) AS uplift, round(p - q - {_ERR}, 6) AS low, round(p - q + {_ERR}, 6) AS high FROM p""")
def W22_exact_deciles(spark, d):
    return C.uplift_deciles(_t(spark, d, "orders"), _score(), "o_orderkey", F.expr(_TREATED), F.expr(_OUTCOME))


_CURVE = f"""{_RANKED}, q AS (SELECT place, sum(CASE WHEN {_TREATED} AND {_OUTCOME} THEN 1 ELSE 0 END) OVER w - sum(CASE WHEN NOT ({_TREATED}) AND {_OUTCOME} THEN 1 ELSE 0 END) OVER w
 * coalesce(sum(CASE WHEN {_TREATED} THEN 1 ELSE 0 END) OVER w / nullif(sum(CASE WHEN NOT ({_TREATED}) THEN 1 ELSE 0 END) OVER w, 0), 0) AS qini FROM r WINDOW w AS (ORDER BY place))"""


def _curve(spark, d):
    return C.qini_points(_t(spark, d, "orders"), _score(), "o_orderkey", F.expr(_TREATED), F.expr(_OUTCOME))


@query(f"WITH {_CURVE} SELECT place, round(CAST(qini AS DOUBLE), 6) AS qini FROM q")
def W20_qini_points(spark, d):
    return _curve(spark, d).select("place", F.round("qini", 6).alias("qini"))


@query(f"WITH {_CURVE} SELECT round(CAST((SELECT sum((a.qini + coalesce(b.qini, 0)) / 2) FROM q a LEFT JOIN q b ON b.place = a.place - 1) / (SELECT count(*) FROM q) - (SELECT arg_max(qini, place) FROM q) / 2 AS DOUBLE), 6) AS area")
def W21_area_over_random(spark, d):
    return C.area_over_random(_curve(spark, d), "place", "qini")


@query(f"WITH {_CURVE}, w AS (SELECT DISTINCT CAST(1 + round(i * ((SELECT count(*) FROM q) - 1) / 20.0) AS BIGINT) AS place FROM range(21) t(i)) SELECT place, round(CAST(qini AS DOUBLE), 6) AS qini FROM q JOIN w USING (place)")
def W25_curve_points(spark, d):
    return C.curve_points(_curve(spark, d), "place", 21).select("place", F.round("qini", 6).alias("qini"))


_HALF = "1.96 * sqrt(var_samp(o_totalprice) FILTER ({t}) / count(*) FILTER ({t}) + var_samp(o_totalprice) FILTER (NOT ({t})) / count(*) FILTER (NOT ({t})))".format(t=_TREATED)
_DIFF = f"avg(o_totalprice) FILTER ({_TREATED}) - avg(o_totalprice) FILTER (NOT ({_TREATED}))"


@query(f"SELECT o_orderpriority, round({_DIFF}, 6) AS diff, round({_DIFF} - {_HALF}, 6) AS low, round({_DIFF} + {_HALF}, 6) AS high FROM orders GROUP BY 1")
def F13_diff_in_means(spark, d):
    return C.diff_in_means(_t(spark, d, "orders"), F.expr(_TREATED), "o_totalprice", "o_orderpriority")


@query(f"SELECT count(*) FILTER (u > 0.2) AS worthwhile, count(*) AS available, 4000 AS affordable, least(count(*) FILTER (u > 0.2), count(*), 4000) AS size FROM (SELECT {_SCORE} - 0.3 AS u FROM orders)")
def T04_policy_size(spark, d):
    return C.policy_size(_t(spark, d, "orders").select((_score() - 0.3).alias("u")), "u", 10000.0, 2.5, 12.5)


@query("""WITH x AS (SELECT c_acctbal > 5000 AS m, 'c_mktsegment' AS feature, coalesce(c_mktsegment, 'unknown') AS level FROM customer UNION ALL SELECT c_acctbal > 5000, 'c_nationkey', coalesce(CAST(c_nationkey AS VARCHAR), 'unknown') FROM customer),
 s AS (SELECT feature, level, round(count(*) FILTER (m) / (SELECT count(*) FROM customer WHERE c_acctbal > 5000), 6) AS share_group, round(count(*) / (SELECT count(*) FROM customer), 6) AS share_all FROM x GROUP BY 1, 2)
 SELECT * FROM s ORDER BY round(abs(share_group - share_all), 6) DESC, feature, level LIMIT 8""")
def T08_traits(spark, d):
    return C.traits(_t(spark, d, "customer"), F.col("c_acctbal") > 5000, ["c_mktsegment", "c_nationkey"])


_T = _TREATED
_SMD = "round((avg({x}) FILTER ({t}) - avg({x}) FILTER (NOT ({t}))) / sqrt((var_samp({x}) FILTER ({t}) + var_samp({x}) FILTER (NOT ({t}))) / 2), 6) AS smd"
_CHI = f"round(power(count(*) FILTER ({_T}) - count(*) * 2 / 3.0, 2) / (count(*) * 2 / 3.0) + power(count(*) FILTER (NOT ({_T})) - count(*) / 3.0, 2) / (count(*) / 3.0), 6) AS chi_square"


@query(f"SELECT 'o_totalprice' AS covariate, {_SMD.format(x='o_totalprice', t=_T)}, {_CHI} FROM orders UNION ALL SELECT 'o_custkey', {_SMD.format(x='o_custkey', t=_T)}, {_CHI} FROM orders")
def M01_balance(spark, d):
    return C.balance(_t(spark, d, "orders"), F.expr(_TREATED), ["o_totalprice", "o_custkey"], 2 / 3)


_PATHS = "SELECT c_custkey, lower(r_name) || '/' || lower(n_name) || '/' || lower(c_mktsegment) AS path FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey"


def _paths(spark, d):
    joined = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(_t(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.select("c_custkey", F.concat_ws("/", F.lower("r_name"), F.lower("n_name"), F.lower("c_mktsegment")).alias("path"))


_NODES = f"""p AS ({_PATHS}), e AS (SELECT c_custkey, array_to_string(string_split(path, '/')[1:i], '/') AS node, i AS depth FROM p, range(1, 4) t(i)), k AS (SELECT node, depth, count(*) AS support FROM e GROUP BY 1, 2 HAVING count(*) >= {{n}})"""


@query(f"WITH {_NODES.format(n=8)} SELECT node, CAST(depth AS INT) AS depth, support FROM k")
def M09_build_taxonomy(spark, d):
    return C.build_taxonomy(_paths(spark, d), "path", 8)


@query(f"WITH {_NODES.format(n=8)} SELECT c_custkey, arg_max(node, e.depth) AS node FROM e JOIN k USING (node) GROUP BY 1")
def J20_effective_label(spark, d):
    return C.effective_label(_paths(spark, d), "c_custkey", "path", C.build_taxonomy(_paths(spark, d), "path", 8))


@query(f"""WITH p AS ({_PATHS}), f AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN regexp_replace(path, '/[^/]*$', '/other') WHEN c_custkey % 9 = 0 THEN 'nowhere' ELSE path END AS path FROM p),
 t AS (SELECT DISTINCT c_custkey, array_to_string(string_split(path, '/')[1:i], '/') AS node FROM p, range(1, 4) r(i) WHERE i <= len(string_split(path, '/'))), g AS (SELECT DISTINCT c_custkey, array_to_string(string_split(path, '/')[1:i], '/') AS node FROM f, range(1, 4) r(i) WHERE i <= len(string_split(path, '/'))),
 b AS (SELECT len(string_split(coalesce(t.node, g.node), '/')) AS depth, t.node AS t, g.node AS g FROM t FULL JOIN g ON t.c_custkey = g.c_custkey AND t.node = g.node)
 SELECT CAST(depth AS INT) AS depth, count(*) FILTER (t IS NOT NULL AND g IS NOT NULL) AS tp, count(*) FILTER (t IS NULL) AS fp, count(*) FILTER (g IS NULL) AS fn, round(2 * count(*) FILTER (t IS NOT NULL AND g IS NOT NULL) / (2 * count(*) FILTER (t IS NOT NULL AND g IS NOT NULL) + count(*) FILTER (t IS NULL) + count(*) FILTER (g IS NULL)), 6) AS f1 FROM b GROUP BY 1""")
def M17_hierarchical_f1(spark, d):
    truth = _paths(spark, d)
    found = truth.withColumn("path", F.when(F.col("c_custkey") % 4 == 0, F.regexp_replace("path", "/[^/]*$", "/other")).when(F.col("c_custkey") % 9 == 0, "nowhere").otherwise(F.col("path")))
    return C.hierarchical_f1(truth, found, "c_custkey", "path")


@query("""SELECT user_id, round(max(1 - abs(2 * p - 1)), 6) AS uncertainty, round(sum(CASE WHEN p > 0 AND p < 1 THEN -(p * log2(p) + (1 - p) * log2(1 - p)) ELSE 0 END), 6) AS entropy
 FROM (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM events GROUP BY 1, 2) GROUP BY 1""")
def M15_uncertainty(spark, d):
    counts = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("user_id").agg(F.sum("n").alias("all"))
    return C.uncertainty(counts.join(total, "user_id").withColumn("p", F.col("n") / F.col("all")), "user_id", "p")


@query(f"""WITH t AS (SELECT user_id, event_type AS a, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT user_id, a, n / sum(n) OVER (PARTITION BY user_id) AS p FROM t), o AS (SELECT user_id, event_type AS a, event_id % 3 AS k, count(*) AS n FROM events GROUP BY 1, 2, 3),
 d AS (SELECT user_id, p, 1.0 AS reach FROM c UNION ALL SELECT o.user_id, o.n / t.n, c.p FROM o JOIN t ON t.user_id = o.user_id AND t.a = o.a JOIN c ON c.user_id = o.user_id AND c.a = o.a), e AS (SELECT *, least({1 - C.EPS}, greatest({C.EPS}, p)) AS q FROM d)
 SELECT user_id, round(max(reach * (1 - abs(2 * p - 1))), 6) AS uncertainty, round(sum(reach * -(q * ln(q) + (1 - q) * ln(1 - q))), 6) AS entropy FROM e GROUP BY 1""")
def M15_tree_uncertainty(spark, d):
    """A tree of two levels for each user: the kind of an event, and its number modulo 3 within the kind."""
    events = _t(spark, d, "events").selectExpr("user_id", "event_type AS a", "concat(event_type, '/', event_id % 3) AS b")
    kinds = events.groupBy("user_id", "a").agg(F.count(F.lit(1)).alias("n"))
    total = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("all"))
    first = kinds.join(total, "user_id").select("user_id", F.col("a").alias("path"), (F.col("n") / F.col("all")).alias("p"))
    within = events.groupBy("user_id", "a", "b").agg(F.count(F.lit(1)).alias("m")).join(kinds, ["user_id", "a"]).select("user_id", F.col("b").alias("path"), (F.col("m") / F.col("n")).alias("p"))
    told = C.tree_uncertainty(first.unionByName(within), "user_id", "path", "p")
    return told.select("user_id", F.round("uncertainty", 6).alias("uncertainty"), F.round("entropy", 6).alias("entropy"))
