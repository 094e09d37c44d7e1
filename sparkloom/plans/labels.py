"""Queries of labels of a tree, classifiers, invariants, tiles and resampling over the given tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as L
from .indexes import _OUTCOME, _TREATED
from .tables import _t, query

_DEEP = "CASE c_custkey % 3 WHEN 0 THEN r_name WHEN 1 THEN r_name || '/' || n_name ELSE r_name || '/' || n_name || '/' || c_mktsegment END"
_PATHS = f"t AS (SELECT c_custkey, {_DEEP} AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_CLOSED = f"{_PATHS}, k AS (SELECT DISTINCT c_custkey, array_to_string(string_split(path, '/')[1:i], '/') AS path FROM t, range(1, 4) r(i) WHERE i <= len(string_split(path, '/')))"


def _paths(spark, d):
    places = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return _t(spark, d, "customer").join(places, "c_nationkey").selectExpr("c_custkey", f"{_DEEP} AS path")


def _closed(spark, d):
    return L.close_labels(_paths(spark, d), "c_custkey", "path")


@query(f"WITH {_CLOSED} SELECT * FROM k")
def M10_close_labels(spark, d):
    return _closed(spark, d)


@query(f"WITH {_CLOSED} SELECT * FROM k WHERE NOT (c_custkey % 4 = 0 AND len(string_split(path, '/')) >= 2)")
def M10_open_labels(spark, d):
    closed = _closed(spark, d)
    return L.open_labels(closed, closed.filter("c_custkey % 4 = 0 AND size(split(path, '/')) = 2"), "c_custkey", "path")


@query(f"WITH {_CLOSED} SELECT * FROM k WHERE c_custkey % 4 = 0 AND len(string_split(path, '/')) = 3")
def M10_inconsistent(spark, d):
    return L.inconsistent(_closed(spark, d).filter("NOT (c_custkey % 4 = 0 AND size(split(path, '/')) = 2)"), "c_custkey", "path")


_MERGE = "'ASIA/' || (SELECT min(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')"


def _asia(spark, d):
    """The first nation of a region: one row of the given table."""
    asia = _t(spark, d, "region").filter("r_name = 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    return "ASIA/" + _t(spark, d, "nation").join(asia, "n_regionkey").agg(F.min("n_name")).first()[0]


@query(f"""WITH {_CLOSED}, s AS (SELECT {_MERGE} AS up), x AS (SELECT up || '/BUILDING' AS source FROM s) SELECT c_custkey, path FROM k, x WHERE path <> source UNION
 SELECT c_custkey, unnest(['EUROPE', 'EUROPE/MERGED']) FROM k, x WHERE path = source""")
def M11_merge_nodes(spark, d):
    return L.merge_nodes(_closed(spark, d), "c_custkey", "path", f"{_asia(spark, d)}/BUILDING", "EUROPE/MERGED")[0]


@query(f"WITH {_CLOSED}, s AS (SELECT {_MERGE} AS up) SELECT c_custkey, 'merged:' || up || '/BUILDING->EUROPE/MERGED' AS reason FROM k, s WHERE path = up || '/BUILDING'")
def M11_merge_review(spark, d):
    return L.merge_nodes(_closed(spark, d), "c_custkey", "path", f"{_asia(spark, d)}/BUILDING", "EUROPE/MERGED")[1]


@query(f"WITH {_CLOSED} SELECT c_custkey, 'split:ASIA' AS reason FROM k GROUP BY 1 HAVING bool_or(path = 'ASIA') AND NOT bool_or(path LIKE 'ASIA/%')")
def M11_split_review(spark, d):
    return L.split_node(_closed(spark, d), "c_custkey", "path", "ASIA")


@query(f"""WITH {_CLOSED}, s AS (SELECT {_MERGE} AS node), m AS (SELECT c_custkey, CASE WHEN path = node OR starts_with(path, node || '/') THEN 'EUROPE/' || substr(path, 6) ELSE path END AS path FROM k, s) SELECT c_custkey, path FROM m UNION SELECT c_custkey, 'EUROPE' FROM m WHERE path LIKE 'EUROPE/%'""")
def M11_move_node(spark, d):
    return L.move_node(_closed(spark, d), "c_custkey", "path", _asia(spark, d), "EUROPE")


@query(f"WITH {_CLOSED}, s AS (SELECT {_MERGE} AS node) SELECT c_custkey, path FROM k, s WHERE path <> node AND NOT starts_with(path, node || '/')")
def M11_retire_node(spark, d):
    return L.retire_node(_closed(spark, d), "c_custkey", "path", _asia(spark, d))


_P = "(c_custkey * 31 + length(path) * 17) % 97 / 100.0 + 0.01"
_MARGINAL = f"""{_CLOSED}, p AS (SELECT c_custkey, path, CAST({_P} AS DOUBLE) AS p FROM k), u AS (SELECT a.c_custkey, a.path, exp(sum(ln(b.p))) AS m FROM p a JOIN p b ON a.c_custkey = b.c_custkey AND (a.path = b.path OR starts_with(a.path, b.path || '/')) GROUP BY 1, 2),
 f AS (SELECT c_custkey, path, 1 / (1 + exp(-(ln(m / (1 - m)) * CASE len(string_split(path, '/')) WHEN 2 THEN 0.5 ELSE 1 END + CASE len(string_split(path, '/')) WHEN 3 THEN 0.7 ELSE 0 END))) AS m FROM u),
 g AS (SELECT a.c_custkey, a.path, min(b.m) AS marginal FROM f a JOIN f b ON a.c_custkey = b.c_custkey AND (a.path = b.path OR starts_with(a.path, b.path || '/')) GROUP BY 1, 2)"""


def _conditional(spark, d):
    return _closed(spark, d).selectExpr("c_custkey", "path", "(c_custkey * 31 + length(path) * 17) % 97 / 100.0D + 0.01D AS p")


def _marginal(spark, d):
    return L.marginals(_conditional(spark, d), "c_custkey", "path", "p", {2: 0.5}, {3: 0.7})


@query(f"WITH {_MARGINAL} SELECT c_custkey, path, round(marginal, 6) AS marginal FROM g")
def M13_marginals(spark, d):
    return _marginal(spark, d).withColumn("marginal", F.round("marginal", 6))


@query(f"WITH {_MARGINAL} SELECT c_custkey, path, round(marginal, 6) AS marginal FROM g WHERE marginal >= 0.4")
def M13_decode(spark, d):
    return L.decode(_marginal(spark, d), "c_custkey", 0.4).withColumn("marginal", F.round("marginal", 6))


@query(f"WITH {_MARGINAL} SELECT c_custkey, round(min(greatest(marginal, 1 - marginal)), 6) AS confidence FROM g GROUP BY 1")
def M13_confidence(spark, d):
    return L.confidence(_marginal(spark, d), "c_custkey").withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {_CLOSED}, p AS (SELECT c_custkey, path, CAST({_P} AS DOUBLE) AS p FROM k) SELECT c_custkey, path, round(p, 6) AS p, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY p DESC, path) AS INT) AS place FROM p WHERE p >= 0.3 QUALIFY place <= 2")
def T06_top_candidates(spark, d):
    return L.top_candidates(_conditional(spark, d), "c_custkey", "path", "p", 0.3, 2).withColumn("p", F.round("p", 6))


_CURVES = "c AS (SELECT o_orderpriority, month(o_orderdate) AS n, avg(o_totalprice) AS score FROM orders GROUP BY 1, 2)"


@query(f"""WITH {_CURVES}, s AS (SELECT *, lag(n) OVER w AS m, lag(score) OVER w AS q FROM c WINDOW w AS (PARTITION BY o_orderpriority ORDER BY n)), t AS (SELECT CAST(unnest([100000, 150000, 200000, 900000]) AS DOUBLE) AS target)
 SELECT o_orderpriority, target, round(arg_min(CASE WHEN m IS NULL THEN n ELSE m + (n - m) * (target - q) / (score - q) END, n) FILTER (score >= target), 6) AS needed FROM s, t GROUP BY 1, 2""")
def M19_labels_to_reach(spark, d):
    curves = _t(spark, d, "orders").groupBy("o_orderpriority", F.month("o_orderdate").alias("n")).agg(F.avg("o_totalprice").alias("score"))
    targets = spark.createDataFrame([(100000.0,), (150000.0,), (200000.0,), (900000.0,)], "target double")
    return L.labels_to_reach(curves, "o_orderpriority", "n", "score", targets, "target").withColumn("needed", F.round("needed", 6))


@query("""WITH m AS (SELECT user_id AS model, user_id % 3 AS version, round(avg(value), 4) AS score FROM events GROUP BY 1), a AS (SELECT model AS baseline, version AS v, score AS s FROM m WHERE model = 1)
 SELECT model, version, score, baseline, CASE WHEN version <> v THEN 'version changed' WHEN score >= s - 2 THEN 'ok' ELSE 'fell' END AS reason, NOT (version = v AND score < s - 2) AS passed FROM m, a WHERE model <> 1""")
def M20_promotion_gate(spark, d):
    models = _t(spark, d, "events").groupBy(F.col("user_id").alias("model")).agg(F.round(F.avg("value"), 4).alias("score")).withColumn("version", F.col("model") % 3)
    return L.promotion_gate(models.filter("model <> 1"), models.filter("model = 1"), 2.0)


_EDGES = "e AS (SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


@query(f"WITH RECURSIVE {_EDGES}, w AS (SELECT node, 1 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.node, depth + 1 FROM e JOIN w ON e.parent = w.node) SELECT node, depth, node NOT IN (SELECT parent FROM e WHERE parent IS NOT NULL) AS leaf FROM w")
def M30_tree_depths(spark, d):
    edges = _t(spark, d, "region").selectExpr("'r' || r_regionkey AS node", "CAST(NULL AS STRING) AS parent")
    edges = edges.unionByName(_t(spark, d, "nation").selectExpr("'n' || n_nationkey AS node", "'r' || n_regionkey AS parent")).unionByName(_t(spark, d, "customer").selectExpr("'c' || c_custkey AS node", "'n' || c_nationkey AS parent"))
    return L.tree_depths(edges, "node", "parent")


@query("SELECT c_nationkey, count(*) AS support, round(avg(c_acctbal), 4) AS score FROM customer GROUP BY 1 HAVING count(*) >= 5 ORDER BY score, c_nationkey LIMIT 5")
def M34_weakest_nodes(spark, d):
    metrics = _t(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("support"), F.round(F.avg("c_acctbal"), 4).alias("score"))
    return L.weakest_nodes(metrics, "support", "score", 5, 5, "c_nationkey")


@query("""WITH a AS (SELECT doc_id, 'q' || quality AS label FROM labels UNION ALL SELECT doc_id, 't' || toxic FROM labels) SELECT d.doc_id, string_agg(DISTINCT a.label, ',' ORDER BY a.label) AS labels, CAST(any_value(embedding[1]) AS DOUBLE) AS first FROM documents d JOIN a ON a.doc_id = d.doc_id JOIN embeddings ON vec_id = d.doc_id GROUP BY 1""")
def J18_labelled_set(spark, d):
    labels = _t(spark, d, "labels")
    notes = labels.selectExpr("doc_id", "'q' || quality AS label").unionByName(labels.selectExpr("doc_id", "'t' || toxic AS label"))
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    made = L.labelled_set(notes, _t(spark, d, "documents"), vectors, "doc_id", "label", "embedding")
    return made.select("doc_id", F.array_join("labels", ",").alias("labels"), F.col("embedding")[0].cast("double").alias("first"))


#: the tables whose invariants are looked for, columns renamed so that two tables share some
_TABLES = {
    "customer": ("customer", {"c_custkey": "custkey", "c_nationkey": "nationkey", "c_acctbal": "acctbal"}),
    "nation": ("nation", {"n_nationkey": "nationkey", "n_regionkey": "regionkey", "n_name": "name"}),
    "orders": ("orders", {"o_orderkey": "orderkey", "o_custkey": "custkey", "o_totalprice": "totalprice"}),
    "region": ("region", {"r_regionkey": "regionkey", "r_name": "name"}),
}
_TYPES = {"name": "s", "acctbal": "d", "totalprice": "d", "nationkey": "i", "regionkey": "i", "custkey": "l", "orderkey": "l"}


def _invariant_sql() -> str:
    views = ", ".join(f"{t}_ AS (SELECT {', '.join(f'{a} AS {b}' for a, b in names.items())} FROM {source})" for t, (source, names) in _TABLES.items())
    told = []
    for t, (_, names) in _TABLES.items():
        numbers = [x for x in names.values() if _TYPES[x] != "s"]
        for x in names.values():
            told += [f"SELECT 'not_null({t}.{x})' AS property, count({x}) = count(*) AS ok FROM {t}_", f"SELECT 'unique({t}.{x})', count(DISTINCT {x}) = count({x}) FROM {t}_"]
        told += [f"SELECT 'non_negative({t}.{x})', count(*) FILTER ({x} < 0) = 0 FROM {t}_" for x in numbers]
        told += [f"SELECT 'le({t}.{a},{t}.{b})', count(*) FILTER ({a} > {b}) = 0 FROM {t}_" for a in numbers for b in numbers if a != b]
        for u, (_, others) in _TABLES.items():
            if t < u:
                told.append(f"SELECT 'row_count_eq({t},{u})', (SELECT count(*) FROM {t}_) = (SELECT count(*) FROM {u}_)")
            told += [f"SELECT 'subset({t}.{x},{u}.{x})', NOT EXISTS (SELECT 1 FROM {t}_ WHERE {x} NOT IN (SELECT {x} FROM {u}_))" for x in names.values() if t != u and x in others.values()]
    return f"WITH {views} SELECT property, CASE WHEN ok THEN 'held' ELSE 'violated' END AS verdict FROM ({' UNION ALL '.join(told)})"


@query(_invariant_sql())
def M25_discover_invariants(spark, d):
    return L.discover_invariants({t: _t(spark, d, source).select(*(F.col(a).alias(b) for a, b in names.items())) for t, (source, names) in _TABLES.items()})


@query("""WITH o AS (SELECT user_id % 40 AS name, CASE WHEN value < 2 AND user_id % 4 = 0 THEN 'violated' WHEN user_id % 40 = 7 OR event_id % 3 = 0 THEN 'vacuous' ELSE 'held' END AS verdict FROM events), n AS (SELECT name, count(*) FILTER (verdict = 'held') AS held, count(*) FILTER (verdict = 'violated') AS violated, count(*) FILTER (verdict = 'vacuous') AS vacuous FROM o GROUP BY 1)
 SELECT *, round(CASE WHEN violated = 0 AND held > 0 THEN greatest(0, 1 - 3 / held) END, 6) AS confidence, CASE WHEN violated > 0 AND name NOT IN (4, 5) THEN 'unexpected' WHEN violated = 0 AND held > 0 AND name IN (4, 5) THEN 'stale' ELSE 'ok' END AS gate FROM n""")
def M27_property_tally(spark, d):
    outcomes = _t(spark, d, "events").selectExpr("user_id % 40 AS name", "CASE WHEN value < 2 AND user_id % 4 = 0 THEN 'violated' WHEN user_id % 40 = 7 OR event_id % 3 = 0 THEN 'vacuous' ELSE 'held' END AS verdict")
    return L.property_tally(outcomes, "name", "verdict", [4, 5]).withColumn("confidence", F.round("confidence", 6))


def _tile_sql(capacity: int, most: int) -> str:
    ctes = ["r0 AS (SELECT o_orderkey AS id, o_orderkey * 7919 % 10007 / 10007 AS x, o_custkey * 104729 % 10009 / 10009 AS y, o_orderkey * 31 % 1009 AS o FROM orders)"]
    for z in range(most + 1):
        ctes.append(f"t{z} AS (SELECT *, CAST(floor(x * {1 << z}) AS BIGINT) AS tx, CAST(floor(y * {1 << z}) AS BIGINT) AS ty FROM r{z}), p{z} AS (SELECT *, row_number() OVER (PARTITION BY tx, ty ORDER BY o, id) AS place FROM t{z}), r{z + 1} AS (SELECT id, x, y, o FROM p{z} WHERE place > {capacity})")
    kept = " UNION ALL ".join(f"SELECT id AS o_orderkey, {z} AS z, tx, ty FROM p{z}" + ("" if z == most else f" WHERE place <= {capacity}") for z in range(most + 1))
    return f"WITH {', '.join(ctes)} {kept}"


@query(_tile_sql(100, 4))
def M22_tile_pyramid(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return L.tile_pyramid(orders, "o_orderkey", F.expr("o_orderkey * 7919 % 10007 / 10007D"), F.expr("o_custkey * 104729 % 10009 / 10009D"), F.expr("o_orderkey * 31 % 1009"), 100, 4)


@query(None)
def M12_node_probabilities(spark, d):
    """No SQL: fitted weights. A test holds the models against plain ones."""
    vectors = _t(spark, d, "embeddings").selectExpr("vec_id", "embedding", "'g' || label % 3 || '/l' || label AS path")
    closed = L.close_labels(vectors, "vec_id", "path")
    models = L.fit_node_classifiers(vectors, closed, closed.select("path").distinct(), "vec_id", "embedding", "path")
    return L.node_probabilities(vectors, models, "vec_id", "embedding", "path")


@query(None)
def M04_bootstrap_difference(spark, d):
    """No SQL: draws from hashes. A test holds the interval against the one of the normal approximation."""
    return L.bootstrap_mean_difference(_t(spark, d, "orders"), "o_orderkey", F.expr(_TREATED), F.expr(_OUTCOME).cast("int"), 200)
