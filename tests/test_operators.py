"""Operators on nulls, ties, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import claims, prices, reports, rulesets, silence
from sparkloom.operators.ranks import numbered, running


def test_running_values_of_ties_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 1, 7), (None, 2, 1), ("a", None, 9), (None, 3, 4), ("b", 3, None)], "k string, o int, v int")
    got = {(r.k, r.o, r.v): r.x for r in running(rows, "sum", F.col("v"), "x", F.col("o"), F.col("v"), by=["k"]).collect()}
    assert got == {("a", None, 9): 9, ("a", 1, 5): 14, ("a", 1, 7): 21, (None, 2, 1): 1, (None, 3, 4): 5, ("b", 3, None): None}
    tied = {(r.k, r.o, r.v): r.x for r in running(rows, "sum", F.lit(1), "x", F.desc("o"), ties=True).collect()}
    assert tied[("a", 1, 5)] == tied[("a", 1, 7)] == 5 and tied[("b", 3, None)] == tied[(None, 3, 4)] == 2
    assert sorted(r.n for r in numbered(rows.unionByName(rows), "n", F.col("o")).collect()) == list(range(1, 13))
    assert running(rows.filter("false"), "max", F.col("v"), "x", F.col("o")).count() == 0


def test_running_values_equal_a_plain_window(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 1009).alias("o"), F.col("id"), (F.col("id") % 13).alias("v"), (F.col("id") % 3).alias("k"))
    got = {r.id: (r.x, r.m) for r in running(running(rows, "sum", F.col("v"), "x", F.col("o"), F.col("id"), by=["k"]), "max", F.col("v"), "m", F.col("o"), F.col("id"), itself=False).collect()}
    plain = rows.selectExpr("id", "sum(v) OVER (PARTITION BY k ORDER BY o, id) AS x", "max(v) OVER (ORDER BY o, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m")
    assert got == {r.id: (r.x, r.m) for r in plain.collect()}


def test_rules_and_claims_on_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], "id long, text string, split string, _pool int")
    assert rulesets.account_rows(empty, empty, empty).first().landed == 0
    assert rulesets.copies_and_leakage(empty, "id", "text", "split").count() == 0
    rows = spark.createDataFrame([(1, None, "pool"), (2, "", "test"), (3, "x", "pool"), (4, "x", "pool"), (4, "x", "pool")], "id long, text string, split string")
    assert sorted((r.id, r.leaked_from, r.copy_of) for r in rulesets.copies_and_leakage(rows, "id", "text", "split").collect()) == [(1, 2, None), (4, None, 3), (4, None, 3)]
    values = spark.createDataFrame([(1.0,), (5.0,), (5.0,), (None,)], "v double")
    assert sorted((r.cut, r.n, r.at_or_above) for r in claims.cutpoints(values, "v", [0, 2, 9], 1).collect()) == [(0.0, 1, 3), (2.0, 2, 2)]
    assert silence.sessions(spark.createDataFrame([], "k long, ts timestamp_ntz"), "k", "ts", "1 hour").count() == 0


def _accepted(rows):
    """Plain day-by-day version of accept_daily over (market, item, day, price, volume)."""
    from math import log
    from statistics import median

    out, kept = {}, {}
    for day in sorted({r[2] for r in rows}):
        today = [r for r in rows if r[2] == day]
        for m, i, _, p, v in today:
            votes = [log(q) for _, j, _, q, w in today if j == i and q and w and w > 0]
            own = kept.setdefault((m, i), [])[-14:]
            reason = None
            if p:
                if len(votes) >= 3:
                    far, limit, kind = abs(log(p) - median(votes)), log(4), "cross_market"
                elif len(own) >= 5:
                    far, kind = abs(log(p) - median(own)), "own_history"
                    limit = max(5 * 1.4826 * median(abs(b - a) for a, b in zip(own, own[1:], strict=False)), log(4))
                else:
                    far, limit, kind = 0, 1, None
                reason = kind if far > limit else "untraded" if far > log(1.5) and not (v and v > 0) else None
                if reason is None:
                    kept[(m, i)].append(log(p))
            out[(m, i, day)] = reason
    return out


def test_accepted_prices_equal_a_plain_fold(spark):
    rows = []
    for m in range(4):
        for i in range(3):
            for day in range(40):
                p = 100.0 + 7 * ((m * 31 + i * 17 + day * 13) % 9)
                p = p * 9 if (m + day * 5 + i) % 23 == 0 else p * 1.8 if (m + day) % 11 == 0 else p
                volume = 5 if i == 0 or (m + day) % 3 == 0 and i == 1 and m < 2 else None if day % 2 else 0
                rows.append((m, i, day, None if (m * day) % 29 == 3 else p, volume))
    found = prices.accept_daily(spark.createDataFrame(rows, "m int, i int, d int, p double, v long"), "m", "i", "d", "p", "v").collect()
    want = _accepted(rows)
    assert {(r.m, r.i, r.d): r.reason for r in found} == want
    assert {"cross_market", "own_history", "untraded", None} == set(want.values())
    assert all((r.accepted is None) == (r.p is None or r.reason is not None) for r in found)


def test_capped_weights_equal_rounds_of_dealing_out(spark):
    groups = {"a": [60, 20, 10, 5, 5], "b": [1, 1], "c": [50, 50, 1, 1, 1, 1], "d": [7, 7, 7, 7], "e": [3]}
    rows = [(g, i, x) for g, xs in groups.items() for i, x in enumerate(xs)]
    got = {(r.g, r.i): r.share for r in prices.cap_weights(spark.createDataFrame(rows, "g string, i int, x long"), "g", "x", 0.3, ["i"]).collect()}
    for g, xs in groups.items():
        share = [x / sum(xs) for x in xs]
        for _ in range(100):  # what is over the cap goes to those below it
            over, below = sum(max(0, s - 0.3) for s in share), sum(s for s in share if s < 0.3)
            share = [0.3 if s >= 0.3 else s * (1 + over / below) for s in share] if len(xs) * 0.3 > 1 else [1 / len(xs)] * len(xs)
        assert all(abs(got[(g, i)] - s) < 1e-9 for i, s in enumerate(share)), g


def test_prices_of_odd_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", None), ("a", -1.0), ("b", 5.0)], "k string, p double")
    got = {r.k: (r.n, r.price) for r in prices.snapshot_prices(rows, ["k"], "p", 3).collect()}
    assert got == {"a": (3, 2.0), "b": (1, None)}
    assert prices.snapshot_prices(rows.filter("false"), ["k"], "p", 3).count() == 0
    empty = spark.createDataFrame([], "m int, i int, d date, price double, volume long")
    assert prices.build_basket(empty, "m", "i", F.lit(True), 1, 0.2, 100).count() == 0
    assert prices.accept_daily(empty, "m", "i", "d", "price", "volume").count() == 0


def test_reports_of_odd_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, "2024-01-01 00:00:00"), (2, None, 0.0, "2024-01-02 00:00:00"), (3, 1.0, 1.0, None), (4, 1.0, 1.0, "2024-01-01 23:00:00")], "id int, lat double, lon double, ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
    seen = reports.live_view(rows, "lat", "lon", "ts", (-5, -5, 5, 5), 4000, 10, "id")
    assert [r.id for r in seen.collect()] == [4]
    assert reports.live_view(rows.filter("false"), "lat", "lon", "ts", (-5, -5, 5, 5), 4000, 10, "id").count() == 0
    with pytest.raises(ValueError, match="unknown lang: xx"):
        reports.filter_categories(rows, {"lang": ["fr", "xx"]}, {"lang": ["fr"]})
    a = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y"), (3, 2.0, None)], "k int, v double, s string")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, "x"), (2, None, "z"), (3, 2.1, None), (4, 0.0, "")], "k int, v double, s string")
    assert reports.same_result(a, a, ["k"], ["v", "s"]).count() == 0
    assert sorted((r.place, r["columns"]) for r in reports.same_result(a, b, ["k"], ["v", "s"]).collect()) == [(2, "s"), (3, "v"), (4, "row")]
    lines = spark.createDataFrame([("a", '{"x": 1}'), ("a", '{"x": null, "y": 2}'), ("a", "{"), ("b", None)], "f string, t string")
    assert sorted((r.source, r.name or "", r.lines, r.invalid, r.with_name, r.missing) for r in reports.feed_profile(lines, "f", "t").collect()) == [("a", "x", 3, 1, 2, 0), ("a", "y", 3, 1, 1, 1), ("b", "", 1, 1, 0, 0)]
    gate = reports.regression_gate(a.filter("k = 2"), a, "k", "v", "v", 1, 0.1, 0.1)
    assert sorted((r.k, r.failure) for r in gate.collect()) == [(1, "missing"), (1, "no_reference"), (3, "missing")]


def test_total_order_holds_across_files(spark, tmp_path):
    rows = spark.range(5000).selectExpr("id * 7919 % 1009 AS k", "id")
    reports.total_order_write(rows, str(tmp_path / "t"), "k")
    files = sorted((tmp_path / "t").glob("part-*"))
    told = [(r.k, r.id) for f in files for r in spark.read.parquet(str(f)).collect()]
    assert told == sorted(told) and len(told) == 5000


def test_fills_wait_for_the_edge_by_price_only(spark):
    """Fills of a plain version; the result is read from sums by cell, snapshot and vanished price, not from orders."""
    rows = [(k % 2, s, k, float(k % 5 + 1), 9 if s == 1 else 9 - k % 3, 9, 1 + k % 4) for k in range(400) for s in (1, 2, 3) if (k + s) % 4 or s == 1] + [(0, 2, None, 1.0, 3, 3, 9)]
    book = spark.createDataFrame(rows, "cell int, snap int, id int, price double, had int, total int, ends int")
    got = prices.infer_fills(book, ["cell"], "snap", "id", "price", "had", "total", "ends")
    wanted = {}
    for cell in (0, 1):
        for s in (2, 3):
            old, new = ([r for r in rows if r[:2] == (cell, t)] for t in (s - 1, s))
            now, was = {r[2]: r for r in new if r[2] is not None}, {r[2] for r in old if r[2] is not None}
            shrunk = [r for r in old if r[2] in now and now[r[2]][4] < r[4]]
            edge = max((r[3] for r in shrunk), default=min((r[3] for r in new), default=float("inf")))
            sold = [(r[4] - now[r[2]][4], r[3]) for r in shrunk] + [(r[4], r[3]) for r in old if r[2] not in now and r[6] > s and r[3] <= edge]
            wanted[cell, s] = (sum(n for n, _ in sold), sum(n * p for n, p in sold), sum(r[3] * r[5] for r in new if r[2] not in was))
    assert {(r.cell, r.snap): (r.fill_qty, r.fill_value, r.new_value) for r in got.collect()} == wanted
    assert spark.read.parquet(*got.inputFiles()).count() <= 4 * (5 + 1)


def test_listings_are_sorted_once_for_join_and_places(spark):
    """With items too many to send to all tasks: one sort of the rows and one of the items; reasons as they were."""
    rows = spark.createDataFrame([(k % 7 if k % 11 else None, k % 3, k, float(k % 5), 1.0, 2.0) for k in range(60)], "i int, d int, o int, p double, v double, t double")
    items = spark.createDataFrame([(k,) for k in range(5)], "i int")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rulesets.listings(rows, items, "i", "p", "v", "t", ["d", "i"], ["o"])
        plan = got._jdf.queryExecution().executedPlan().toString()
        reasons = {r.o: r.reason for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("Sort [") == 2
    seen, wanted = set(), {}
    for k in range(60):
        i, key = (k % 7 if k % 11 else None), (k % 3, k % 7 if k % 11 else None)
        wanted[k] = "missing_i" if i is None else "unknown_item" if i > 4 else "bad_price" if k % 5 == 0 else "duplicate_in_snapshot" if key in seen else None
        seen.add(key)
    assert {k for k in reasons if (reasons[k] or "").replace("missing_fields", "missing_i") != (wanted[k] or "")} == set()
