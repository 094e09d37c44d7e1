import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import circles
from sparkloom.operators import tracks as T
from sparkloom.plans import silence


def test_cells_of_places_on_an_edge_are_those_of_sql(spark):
    """Latitudes on the edges of cells: the last bit of the arc sine decides the cell."""
    gaps = [(k, 0, 0.5 * k, 10.25, 8.0 if k % 2 else 0.5, 20.0, 0.5 * k, 10.25, 5.0, 200.0) for k in range(-178, 179)]
    names = ["thing", "silent_from", "lat0", "lon0", "knots0", "course0", "lat1", "lon1", "knots1", "course1"]
    grid = [(cx, cy, (cx * 37 + cy * 101) % 997 / 997) for cx in range(-8, 60) for cy in range(-181, 181)]
    con = duckdb.connect()
    for table, columns, rows in (("q", names, gaps), ("grid", ["cx", "cy", "reliability"], grid)):
        frame = spark.createDataFrame(rows, columns).toPandas()  # noqa: F841
        con.execute(f"CREATE TABLE {table} AS SELECT * FROM frame")
    want = con.execute(f"WITH {silence._HEARD} SELECT * FROM heard ORDER BY thing").fetchall()
    found = T.reception(spark.createDataFrame(gaps, names), spark.createDataFrame(grid, ["cx", "cy", "reliability"]), silence._RULES)
    assert [tuple(r) for r in found.orderBy("thing").collect()] == [pytest.approx(r) for r in want]


def test_others_near_by_blocks_equal_brute_force(spark, monkeypatch):
    """Around the date line and a pole, with things heard again and again, own reports, and a crowd that is cut into
    parts; no pair leaves its task, so a crowd's pairs are not shuffled."""
    monkeypatch.setattr(circles, "REPORTS", 50)
    monkeypatch.setattr(circles, "SPOTS", 20)
    draw = random.Random(5)
    places = [(55.0, 10.0), (0.0, 180.0), (-0.1, -179.99), (89.9, 40.0), (-89.95, 170.0), (10.0, 359.9)]
    at = lambda k: (places[k % 6][0] + draw.uniform(-0.3, 0.3) * (k % 6 < 3), places[k % 6][1] + draw.uniform(-0.4, 0.4))
    reports = [(f"s{draw.randrange(60)}", *at(k), float(draw.randrange(20_000))) for k in range(1_500)] + [("s1", float("nan"), 10.0, 5.0)]
    spots = [(f"s{k % 70}", k, *at(k), float(k * 61), float(k * 61) + draw.choice([0.0, 600.0, 1800.0])) for k in range(300)]
    near = {}
    for thing, k, lat, lon, t0, t1 in spots:
        near[k] = len({o for o, lat2, lon2, t in reports if o != thing and t0 < t <= t1 and circles._metres(lat, lon, lat2, lon2) <= 20_000.0})
    asked = spark.createDataFrame(spots, ["thing", "silent_from", "lat", "lon", "t0", "t1"])
    found = circles.others_near(asked, spark.createDataFrame(reports, ["other", "lat", "lon", "t"]), ["thing", "silent_from"], 20_000.0, 1800.0)
    assert sum(near.values()) > 500
    got = {r.silent_from: r.n_near for r in found.collect()}
    assert {k: got.get(k, 0) for k in near} == near
    gaps = asked.withColumnsRenamed({"lat": "lat0", "lon": "lon0"}).selectExpr("*", "0D AS knots0", "0D AS course0", "60D AS seconds").withColumn("silent_from", F.timestamp_seconds("silent_from"))
    heard = spark.createDataFrame([("s1", 0, 1.0, 2.0)], ["thing", "ts", "lat", "lon"]).withColumn("ts", F.timestamp_seconds("ts"))
    plan = T.neighbours(gaps, heard, silence._RULES)._jdf.queryExecution().toString()
    assert "CoGroup" in plan and "count(distinct" not in plan.lower()


def test_a_distance_on_the_radius_counts(spark):
    """The edge is measured by the formula, not by the cosine that finds pairs."""
    for k in range(40):
        lat, lon = 0.01 * k, 0.3 + 0.001 * k
        edge = circles._metres(55.0, 10.0, 55.0 + lat, 10.0 + lon)
        row = pa.table({"thing": [1], "silent_from": [0], "lat": [55.0], "lon": [10.0], "t0": [0.0], "t1": [9.0]})
        other = pa.table({"other": [2], "lat": [55.0 + lat], "lon": [10.0 + lon], "t": [9.0]})
        counts = [circles._block(r, 9.0, ["thing", "silent_from"])(row, other)["n_near"][0].as_py() for r in (edge, edge * (1 - 1e-15))]
        assert counts == [1, 0]


def test_receptions_are_told_as_sql_rounds_them(spark):
    """Shares of hours that lie between two hundredths, such as 138 of 240."""
    shares = [(k, n, k / n) for n in (40, 200, 240) for k in range(n + 1)]
    facts = spark.createDataFrame([(*s, 1.0) for s in shares], ["k", "n", "reception_from", "reception_to"])
    facts = facts.selectExpr("*", "90000D AS seconds", "100D AS metres", "8.25D AS knots0", "1L AS n_near", "timestamp_seconds(9) AS silent_to")
    got = {(r.k, r.n): r.reasons for r in T.judged(facts, T.Rules(least_reception=0.0)).collect()}
    con = duckdb.connect()
    for k, n, share in shares:
        told, knots = con.execute("SELECT CAST(round(CAST(? AS DOUBLE), 2) AS VARCHAR), CAST(round(CAST(8.25 AS DOUBLE), 1) AS VARCHAR)", [share]).fetchone()
        assert f"reception {told} where it vanished" in got[k, n] and f"at {knots} kn" in got[k, n]
