"""Operators of labels, classifiers, tiles and resampling against plain versions, on odd rows and empty tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import labels as L


def test_trees_and_labels_of_odd_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a/b/c"), (1, "a/b/c"), (1, "a/x"), (2, None), (3, ""), (4, "a")], "k int, path string")
    closed = L.close_labels(rows, "k", "path")
    assert sorted((r.k, r.path) for r in closed.collect()) == [(1, "a"), (1, "a/b"), (1, "a/b/c"), (1, "a/x"), (4, "a")]
    assert L.inconsistent(closed, "k", "path").count() == 0
    assert L.close_labels(rows.filter("false"), "k", "path").count() == 0
    # a label below a name that only begins alike stays
    alike = spark.createDataFrame([(1, "a"), (1, "ab"), (1, "ab/c")], "k int, path string")
    assert sorted(r.path for r in L.retire_node(alike, "k", "path", "a").collect()) == ["ab", "ab/c"]
    edges = spark.createDataFrame([("r", None), ("x", "r"), ("y", "x"), ("p", "q"), ("q", "p"), ("z", "gone")], "n string, up string")
    assert sorted((r.n, r.depth, r.leaf) for r in L.tree_depths(edges, "n", "up").collect()) == [("r", 1, False), ("x", 2, False), ("y", 3, True)]


def test_marginals_need_all_ancestors_and_never_rise(spark):
    rows = spark.createDataFrame([(1, "a", 0.5), (1, "a/b", 0.8), (1, "c/d", 0.9), (2, "a", 0.0), (2, "a/b", 1.0)], "k int, path string, p double")
    got = {(r.k, r.path): r.marginal for r in L.marginals(rows, "k", "path", "p", {}, {2: 5.0}).collect()}
    assert set(got) == {(1, "a"), (1, "a/b"), (2, "a"), (2, "a/b")}
    assert math.isclose(got[(1, "a")], 0.5) and math.isclose(got[(1, "a/b")], 0.5) and got[(2, "a/b")] <= got[(2, "a")] < 1e-9


def test_node_classifiers_equal_plain_descent(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    top = rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] * 2 - 0.5)))
    low = top & (rng.random(300) < 1 / (1 + np.exp(-x[:, 1])))
    vectors = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "k int, v array<float>")
    told = [(i, "a") for i in range(300) if top[i]] + [(i, "a/b") for i in range(300) if low[i]] + [(i, "all") for i in range(300)]
    labels = spark.createDataFrame(told, "k int, path string")
    nodes = spark.createDataFrame([("a",), ("a/b",), ("all",), ("none",), ("none/x",)], "path string")
    got = {r.path: r for r in L.fit_node_classifiers(vectors, labels, nodes, "k", "v", "path", penalty=0.5).collect()}
    assert set(got) == {"a", "a/b", "all", "none"}
    assert (got["a"].n, got["a"].positives) == (300, top.sum()) and (got["a/b"].n, got["a/b"].positives) == (top.sum(), low.sum())
    assert math.isclose(got["none"].weights[0], math.log(0.5 / 300.5)) and got["all"].weights[1:] == [0, 0, 0]
    for node, rows, y in (("a", x, top), ("a/b", x[top], low[top])):
        wide, w = np.hstack([np.ones((len(rows), 1)), rows.astype(np.float32)]), np.zeros(4)
        for _ in range(20000):
            w -= 0.003 * (wide.T @ (1 / (1 + np.exp(-wide @ w)) - y) + 0.5 * np.array([0, *w[1:]]))
        assert np.allclose(got[node].weights, w, atol=1e-4), node


def test_bootstrap_interval_is_that_of_the_normal_approximation(spark):
    rows = spark.range(6000).selectExpr("id", "id % 3 = 0 AS t", "CAST(pmod(xxhash64(id), 100) < CASE WHEN id % 3 = 0 THEN 40 ELSE 30 END AS INT) AS y")
    got = L.bootstrap_mean_difference(rows, "id", F.col("t"), F.col("y"), 400).first()
    p, q = (rows.filter(f"t = {v}").agg(F.avg("y")).first()[0] for v in ("true", "false"))
    half = 1.96 * math.sqrt(p * (1 - p) / 2000 + q * (1 - q) / 4000)
    assert math.isclose(got.estimate, p - q, abs_tol=1e-12)
    assert abs(got.low - (p - q - half)) < half * 0.2 and abs(got.high - (p - q + half)) < half * 0.2
    assert L.bootstrap_mean_difference(rows.filter("false"), "id", F.col("t"), F.col("y"), 10).first().estimate is None


def test_tiles_keep_every_point_once(spark):
    same = spark.range(500).selectExpr("id", "0.25D AS x", "0.75D AS y")
    rows = same.unionByName(spark.createDataFrame([(1000, None, 0.5), (1001, 1.0, 0.5), (1002, 0.0, 0.0)], "id long, x double, y double"))
    made = L.tile_pyramid(rows, "id", F.col("x"), F.col("y"), F.col("id"), 10, 3).collect()
    assert sorted(r.id for r in made) == [*range(500), 1002]
    assert {z: sum(r.z == z for r in made) for z in range(4)} == {0: 10, 1: 11, 2: 10, 3: 470}


def test_invariants_tally_and_gate_of_empty_tables(spark):
    a = spark.createDataFrame([(1, 2), (2, 2), (None, 5)], "x int, y int")
    got = {r.property: r.verdict for r in L.discover_invariants({"a": a, "b": a.filter("x = 1"), "c": a.filter("false")}).collect()}
    assert got["not_null(a.x)"] == "violated" and got["unique(a.x)"] == "held" and got["unique(a.y)"] == "violated" and got["le(a.x,a.y)"] == "held"
    assert got["subset(b.x,a.x)"] == "held" and got["subset(a.x,b.x)"] == "violated" and got["row_count_eq(a,b)"] == "violated"
    assert not any(p.startswith("not_null(c") for p in got)
    none = spark.createDataFrame([], "model int, version int, score double")
    assert L.promotion_gate(spark.createDataFrame([(1, 1, 0.5)], none.schema), none, 0.1).first().reason == "first model"
