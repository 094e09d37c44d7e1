import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import learners, measures, nearest, reports
from sparkloom.plans import QUERIES

DATA = "/root/testdata/sf0.001"


def _plain(vectors, queries, k, score, *order):
    """All pairs, by expressions."""
    pairs = vectors.join(queries.selectExpr("id AS query_id", "v AS q"), F.col("id") != F.col("query_id"))
    scored = pairs.select("query_id", F.col("id").alias("neighbour_id"), F.expr(score).alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order, "neighbour_id"))).filter(f"place <= {k}")


def _same(found, wanted, name):
    told = lambda d, n: sorted((r["query_id"], r["neighbour_id"], r["place"], repr(r[n])) for r in d.collect())
    assert told(found, name) == told(wanted, "score")


@pytest.fixture
def small(monkeypatch):
    for name, n in (("VECTORS", 40), ("QUERIES", 7), ("ROWS", 3)):
        monkeypatch.setattr(nearest, name, n)


def _rows():
    rng = random.Random(3)
    rows = [(k, [round(rng.gauss(0, 1), 1) for _ in range(4)]) for k in range(150)]
    rows += [(150 + k, [1.0, 2.0, 0.5, -1.0]) for k in range(60)]
    return rows + [(210, None), (211, [1.0, None, 2.0, 3.0]), (212, [1.0, 2.0]), (213, [math.nan, 1.0, 1.0, 1.0]), (214, [2.0, 1.0])]


def test_nearest_by_cosine_in_blocks_are_those_of_all_pairs(spark, small):
    vectors = spark.createDataFrame(_rows(), "id long, v array<double>").repartition(3)
    queries = vectors.filter("id % 9 = 0 OR id > 208")
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    score = f"round({dot.format('v', 'q')} / sqrt({dot.format('v', 'v')} * {dot.format('q', 'q')}), 6)"
    found = measures.knn(vectors, queries, "id", "v", 5)
    _same(found, _plain(vectors, queries, 5, score, F.desc("score")), "cosine")
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_nearest_in_the_plane_in_blocks_are_those_of_all_pairs(spark, small):
    rows = [(k, None if v is None else v[:2]) for k, v in _rows()]
    points = spark.createDataFrame(rows, "id long, v array<double>").selectExpr("id", "v", "v[0] AS x", "v[1] AS y")
    queries = points.filter("id % 9 = 0 OR id > 208")
    score = "(v[0] - q[0]) * (v[0] - q[0]) + (v[1] - q[1]) * (v[1] - q[1])"
    found = reports.knn_2d(points, queries, "id", "x", "y", 5)
    _same(found, _plain(points, queries, 5, score, "score"), "squared")
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_every_row_asked_in_wide_blocks_has_the_neighbours_of_all_pairs(spark, monkeypatch):
    for name, n in (("VECTORS", 64), ("QUERIES", 10), ("ROWS", 32)):
        monkeypatch.setattr(nearest, name, n)
    assert nearest._counts(605, 605) == (1, 32)
    rng = random.Random(4)
    more = [(300 + k, [round(rng.gauss(0, 1), 2) for _ in range(4)]) for k in range(390)]
    rows = spark.createDataFrame(_rows() + more, "id long, v array<double>").repartition(3).cache()
    dot = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    score = f"round({dot.format('v', 'q')} / sqrt({dot.format('v', 'v')} * {dot.format('q', 'q')}), 6)"
    _same(measures.knn(rows, rows, "id", "v", 5), _plain(rows, rows, 5, score, F.desc("score")), "cosine")
    points = rows.selectExpr("id", "slice(v, 1, 2) AS v", "v[0] AS x", "v[1] AS y")
    score = "(v[0] - q[0]) * (v[0] - q[0]) + (v[1] - q[1]) * (v[1] - q[1])"
    _same(reports.knn_2d(points, points, "id", "x", "y", 5), _plain(points, points, 5, score, "score"), "squared")


def test_block_gives_the_nearest_of_brute_force_whatever_is_cut_off():
    rng = np.random.default_rng(5)
    alike = rng.normal(size=(2, 1, 64)) + np.array([0, 1e-4])[:, None, None] * rng.normal(size=(2, 400, 64))  # copies and near copies
    vectors = np.concatenate([rng.normal(size=(1500, 64)), *alike]).astype(np.float32)
    table = lambda m: pa.table({"id": pa.array(np.arange(len(m))), "vec": pa.array(list(m.astype(float)), pa.list_(pa.float64()))})
    unit = vectors.astype(float) / np.sqrt((vectors.astype(float) ** 2).sum(axis=1))[:, None]
    for cosine, matrix, score in ((True, vectors, -np.round(unit @ unit.T, 6)), (False, vectors[:, :2], nearest._squares(*[vectors[:, :2].astype(float)] * 2))):
        made = nearest._block(10, cosine)(table(matrix), table(matrix))
        rows = {}
        for q, v, a, b, c in zip(*(made.column(n).to_pylist() for n in ("query_id", "neighbour_id", "a", "b", "c")), strict=True):
            rows.setdefault(q, []).append((-round(a / math.sqrt(b * c), 6) if cosine else a, v))
        np.fill_diagonal(score, math.inf)
        for q in range(len(matrix)):
            assert [v for _, v in sorted(rows[q])[:10]] == np.lexsort((np.arange(len(matrix)), score[q]))[:10].tolist()
        assert made.num_rows < 25 * len(matrix)


def test_quality_of_a_projection_is_told_for_every_vector(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    flat = {r.vec_id: (r.x, r.y) for r in learners.pca2(table, "vec_id", "embedding")[0].collect()}
    rows = sorted((r.vec_id, r.embedding, r.label) for r in table.collect())
    ids, labels = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    vectors, places = np.array([r[1] for r in rows], dtype=float), np.array([flat[i] for i in ids])

    def ten(score, i):
        score[i] = math.inf
        return np.lexsort((ids, score))[:10]

    squares, wanted = (vectors**2).sum(axis=1), []
    for i, key in enumerate(ids):
        high = ten(-np.round(vectors @ vectors[i] / np.sqrt(squares * squares[i]), 6), i)
        low = ten(((places - places[i]) ** 2).sum(axis=1), i)
        wanted.append((int(key), round(len(set(high) & set(low)) / 10, 6), round(float((labels[low] == labels[i]).mean()), 6)))
    found = QUERIES["M24_projection_quality"](spark, DATA)
    assert sorted((r.query_id, round(r.recall, 6), round(r.purity, 6)) for r in found.collect()) == wanted
