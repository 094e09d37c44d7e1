"""Fitted models on planted structure, and their sums against plain ones."""

import math

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scalars as X
from sparkloom.operators import learners as L


@pytest.fixture(scope="module")
def units(spark):
    """The treatment helps where a is high, hurts where it is low, and b says nothing about it."""
    rows = spark.range(4000).selectExpr("id", "pmod(xxhash64(id, 1), 1000) / 1000D AS a", "pmod(xxhash64(id, 2), 1000) / 1000D AS b", "id % 2 = 0 AS t", "pmod(xxhash64(id, 3), 1000) / 1000D AS u")
    return rows.withColumn("y", (F.col("u") < 0.4 + 0.2 * F.col("b") + F.when(F.col("t"), 0.6 * F.col("a") - 0.3).otherwise(0)).cast("int"))


@pytest.mark.parametrize("kind", ["s", "t", "x"])
def test_learners_find_a_planted_effect(units, kind):
    held = L.fit_learner(kind, units.filter("id % 4 < 2"), ["a", "b"], "t", "y", "id")(units.filter("id % 4 >= 2"))
    assert held.agg(F.corr("score", "a")).first()[0] > 0.6 and held.count() == 2000


def test_area_of_learners_equals_a_plain_sum(spark, units):
    scores = [units.select(F.lit(n).alias("m"), "id", e.alias("score"), "t", "y") for n, e in (("true", F.round("a", 2)), ("noise", F.round("u", 1)))]
    got = {r.m: r for r in L.evaluate_learners(scores[0].unionByName(scores[1]), "m", "score", "id", F.col("t"), F.col("y")).collect()}
    for df in scores:
        rows = sorted(df.collect(), key=lambda r: (-r.score, r.id))
        heights, n1, n0, k1, k0 = [], 0, 0, 0, 0
        for r in rows:
            n1, n0, k1, k0 = n1 + r.t, n0 + (not r.t), k1 + r.t * r.y, k0 + (not r.t) * r.y
            heights.append(k1 - (k0 * n1 / n0 if n0 else 0))
        n = len(rows)
        assert math.isclose(got[rows[0].m].qini, (sum(heights) / n - heights[-1] * (n + 1) / (2 * n)) / n, abs_tol=1e-12)
    assert got["true"].place == 1


def test_stale_models_are_refused_and_unknown_learners_too(units):
    with pytest.raises(ValueError, match="the model knows data a, not b"):
        L.score_units(lambda d: d, units, "a", "b")
    with pytest.raises(ValueError, match="unknown learner z"):
        L.fit_learner("z", units, ["a"], "t", "y", "id")


def test_calibration_batches_and_clusters(spark):
    rows = spark.range(3000).selectExpr("id", "1 AS depth", "pmod(xxhash64(id), 997) / 997D AS p").withColumn("y", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1000)) / 1000 < 1 / (1 + F.exp(-(2 * F.ln(F.greatest("p", F.lit(1e-6)) / (1 - F.least("p", F.lit(1 - 1e-6)))) + 0.5))))
    few = spark.createDataFrame([(-1, 2, 0.5, True)], "id long, depth int, p double, y boolean")
    got = {r.depth: r for r in L.calibrate(rows.unionByName(few), "depth", "p", "y").collect()}
    assert abs(got[1].slope - 2) < 0.3 and abs(got[1].shift - 0.5) < 0.3 and (got[2].slope, got[2].shift) == (1.0, 0.0)
    ends = [[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]
    vectors = spark.createDataFrame([(i, [v * (1 + i) for v in ends[i % 3]]) for i in range(30)], "id int, v array<float>")
    clusters = {}
    for r in L.kmeans(vectors, "id", "v", 3).collect():
        clusters.setdefault(r.cluster, set()).add(r.id % 3)
    assert sorted(map(len, clusters.values())) == [1, 1, 1]
    batch = L.select_batch(vectors.selectExpr("id", "1 - id / 30D AS score"), vectors, "id", "score", "v", 6).collect()
    assert sorted(r.place for r in batch) == [1, 2, 3, 4, 5, 6] and len({r.id for r in batch}) == 6
    assert {r.id for r in batch if r.why == "uncertain"} == {0, 1, 2}
    flat, shares = L.pca2(vectors, "id", "v")
    assert flat.count() == 30 and math.isclose(sum(shares), 1)


def test_flat_text_model_tells_two_vocabularies_apart(spark):
    rows = spark.range(200).selectExpr("id", "CASE WHEN id = 199 THEN NULL WHEN id % 2 = 0 THEN 'red apple ' || id ELSE 'blue sky ' || id END AS text", "CAST(id % 2 AS INT) AS y")
    made = L.tfidf_baseline(rows, "id", "text", "y", F.col("id") % 5 != 0).filter("NOT train").collect()
    assert len(made) == 40 and all((r.p > 0.5) == (r.y == 1) for r in made)


def test_scalars_of_nulls_and_edges(spark):
    row = spark.sql("SELECT CAST(NULL AS STRING) AS t, array(1D, 3D, 3D) AS a, CAST(NULL AS ARRAY<DOUBLE>) AS n, timestamp_ntz'2024-01-01 00:00:02' AS ts")
    got = row.select(X.tag_topics(F.col("t"), {"x": ["a"]}).alias("topics"), X.argmax(F.col("a")).alias("best"), X.argmax(F.col("n")).alias("unknown"), X.fix_time(F.col("ts"), F.lit(58)).alias("back"), X.fix_time(F.col("ts"), F.lit(6)).alias("ahead"), X.fix_time(F.col("ts"), F.lit(60)).alias("none"), X.surprise_bits(F.lit(0.0)).alias("s"), X.softmax_kl(F.col("a"), F.col("a")).alias("kl")).first()
    assert (got.topics, got.best, got.unknown, got.s, got.kl) == ([], 1, None, None, 0.0)
    assert [str(x) for x in (got.back, got.ahead, got.none)] == ["2023-12-31 23:59:58", "2024-01-01 00:00:06", "2024-01-01 00:00:02"]
