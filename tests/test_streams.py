"""Stateful and incremental operators: stream twins against the batch forms, restarts, late data and redelivery."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import fragments, incremental, reservations, tracks
from sparkloom.plans import streams
from sparkloom.sources import runs
from sparkloom.streaming import detection, sink
from sparkloom.streaming import fragments as stream_fragments
from sparkloom.streaming import reservations as stream_reservations
from sparkloom.streaming.events import drained

DATA = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def in_batches(df, order, cuts, folder, run):
    """Rows of df in an order, written to a folder in several pieces; the stream runs, and stops, after each of them."""
    rows = df.orderBy(*order).collect()
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        df.sparkSession.createDataFrame(rows[a:b], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = run(df.sparkSession.readStream.schema(df.schema).parquet(f"{folder}/in"), f"{folder}/job")
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("cuts", [[400], [100, 350, 351, 900]])
def test_reservations_stream_gives_the_batch_verdicts(spark, tmp_path, cuts):
    commands, sections, sales = streams._sales(spark, DATA)
    commands = commands.withColumn("at", F.col("at").cast("timestamp"))
    wanted = sorted(map(tuple, reservations.replay(commands, sections, sales, streams._TTL).collect()), key=str)
    sections, sales = sections.cache(), sales.cache()
    got = in_batches(commands, ["at", "seq"], cuts, tmp_path, lambda s, job: drained(stream_reservations.replay(s, sections, sales, streams._TTL, "1 day"), job))
    assert got == wanted and len({x[2] for x in got}) > 8


def test_reservation_rules(spark):
    C = "sale string, seq long, at timestamp, kind string, user string, section string, qty long, key string"
    rows = [
        ("s", 1, 0, "reserve", "a", "x", 2, "k1"),
        ("s", 2, 11, "reserve", "a", "x", 2, "k1"),
        ("s", 3, 12, "reserve", "a", "x", 2, "k1"),
        ("s", 4, 13, "reserve", "a", "x", 1, "k2"),
        ("s", 5, 14, "reserve", "b", "x", 9, "k1"),
        ("s", 6, 15, "reserve", "b", "x", 0, "k1"),
        ("s", 7, 16, "confirm", "a", None, None, "k1"),
        ("s", 8, 17, "confirm", "a", None, None, "k1"),
        ("s", 9, 18, "reserve", "a", "y", 2, "k3"),
        ("s", 10, 19, "reserve", "b", "y", 1, "k2"),
        ("s", 11, 120, "confirm", "b", None, None, "k2"),
        ("s", 12, 121, "release", "b", None, None, "k2"),
        ("s", 13, 122, "adjust", "admin", "x", -3, None),
        ("s", 14, 123, "adjust", "admin", "x", -1, None),
        ("s", 15, 2000, "reserve", "a", "y", 1, "k1"),
        ("s", 16, 2001, "release", "a", None, None, "k1"),
        ("s", 17, 2002, "reserve", "c", "z", 1, "k"),
        ("s", 18, 2003, "order", "c", "x", 1, "k"),
        (None, 19, 2003, "reserve", "c", "x", 1, "k"),
        ("s", 20, None, "reserve", "c", "x", 1, "k"),
    ]
    commands = spark.createDataFrame([(a, b, None if t is None else at(t), *r) for a, b, t, *r in rows], C)
    sections = spark.createDataFrame([("s", "x", 5), ("s", "y", 5)], "sale string, section string, total int")
    sales = spark.createDataFrame([("s", at(10), 100, 3)], "sale string, opens timestamp, hold_seconds int, most int")
    got = {x.seq: (x.verdict, x.available) for x in reservations.replay(commands, sections, sales, 1000).collect()}
    assert [got[i + 1] for i in range(20)] == [
        ("not_on_sale", 5), ("held", 3), ("replayed", 3), ("already_holding", 3), ("sold_out", 3), ("invalid_quantity", 3), ("confirmed", None), ("confirmed", None),
        ("limit_exceeded", 5), ("held", 4), ("hold_expired", None), ("hold_expired", None), ("stock_corrected", 0), ("correction_below_committed", 0),
        ("held", 4), ("released", None), ("no_such_section", None), ("malformed", None), ("malformed", None), ("malformed", None),
    ]
    assert reservations.replay(commands.filter("false"), sections, sales, 1000).count() == 0


def test_stock_is_never_promised_twice(spark):
    r = random.Random(4)
    rows = [("s", i, at(i * 7), r.choice(["reserve", "reserve", "confirm", "release", "adjust"]), f"u{r.randrange(30)}", r.choice("xy"), r.randrange(-3, 5), f"k{r.randrange(9)}") for i in range(3000)]
    commands = spark.createDataFrame(rows, "sale string, seq long, at timestamp, kind string, user string, section string, qty long, key string")
    sections = spark.createDataFrame([("s", "x", 20), ("s", "y", 3)], "sale string, section string, total int")
    sales = spark.createDataFrame([("s", at(0), 300, 50)], "sale string, opens timestamp, hold_seconds int, most int")
    got = reservations.replay(commands, sections, sales, 2000).collect()
    assert len(got) == 3000 and min(x.available for x in got if x.available is not None) == 0


PARTS = "station string, total int, num int, ts timestamp, tie long, payload string"


def test_fragments_meet_every_outcome(spark, tmp_path):
    rows = [
        ("a", 2, 1, 0, 1, "x"), ("a", 2, 2, 1, 2, "y"), ("a", 2, 2, 2, 3, "late twin"), ("a", 2, 1, 3, 4, "first"), ("a", 2, 1, 4, 5, "again"), ("a", 2, 2, 20, 6, "too late"),
        ("b", 3, 1, 0, 7, "1"), ("b", 3, 3, 1, 8, "3"), ("b", 3, 2, 2, 9, "2"), ("b", 3, 4, 3, 10, "?"), ("b", 3, 0, 3, 11, "?"), ("c", 1, 1, 5, 12, "whole"), ("c", 1, 1, 5, 13, None),
        ("d", 3, 1, 6, 14, "1"), ("d", 3, 2, 7, 15, "2"), ("e", 3, 1, 39, 16, "open"), (None, 2, 1, 5, 17, "no key"), ("d", None, 1, 5, 18, "no total"), ("f", 2, 2, 50, 19, "orphan"),
    ]
    parts = spark.createDataFrame([(s, t, n, at(x), tie, p) for s, t, n, x, tie, p in rows], PARTS)
    args = (["station"], "total", "num", "ts", "tie", "payload", 10.0)
    got = sorted(map(tuple, fragments.join_fragments(parts, *args, T0.timestamp() + 45).collect()), key=lambda r: r[1])
    assert got == [
        ("a", 1, "complete", 2, "xy"), ("a", 3, "orphan_fragment", 1, "late twin"), ("a", 4, "incomplete", 1, "first"), ("a", 5, "incomplete", 1, "again"), ("a", 6, "orphan_fragment", 1, "too late"),
        ("b", 7, "fragment_out_of_order", 2, "13"), ("b", 9, "orphan_fragment", 1, "2"), ("b", 10, "fragment_out_of_range", 1, "?"), ("b", 11, "fragment_out_of_range", 1, "?"), ("c", 12, "complete", 1, "whole"), ("c", 13, "complete", 1, ""),
        ("d", 14, "incomplete", 2, "12"), (None, 17, "fragment_out_of_range", 1, "no key"), ("d", 18, "fragment_out_of_range", 1, "no total"), ("f", 19, "orphan_fragment", 1, "orphan"),
    ]
    assert fragments.join_fragments(parts.filter("false"), *args, 0.0).count() == 0
    streamed = in_batches(parts, ["ts", "tie"], [4, 5, 11], tmp_path, lambda s, job: drained(stream_fragments.join_fragments(s, *args, "5 seconds"), job))
    assert streamed == sorted(got, key=str)


def test_fragments_stream_gives_the_batch_rows(spark, tmp_path):
    parts = streams._parts(spark, DATA).withColumn("ts", F.col("ts").cast("timestamp"))
    args = (["station"], "total", "num", "ts", "tie", "payload", streams._WAIT)
    last = parts.agg(F.max("ts")).first()[0]
    wanted = sorted(map(tuple, fragments.join_fragments(parts, *args, last.timestamp() - 86_400).collect()), key=str)
    got = in_batches(parts, ["ts", "tie"], [150, 600, 601], tmp_path, lambda s, job: drained(stream_fragments.join_fragments(s, *args, "1 day"), job))
    assert got == wanted and len({x[2] for x in got}) == 5


REPORTS = "thing long, ts timestamp, lat double, lon double, knots double, course double"
RULES = tracks.Rules(lookback_h=6.0)


def reports(spark, rows):
    return spark.createDataFrame([(k, at(60 * m), 60.1, 5.05 + lon, knots, 90.0) for k, m, lon, knots in rows], REPORTS)


def test_late_data_withdraws_a_silence_and_redelivery_changes_nothing(spark, tmp_path):
    heard = [(k, m, 0.001 * m, 2.0) for k in (1, 2) for m in range(0, 181, 10)]
    silent = [(3, m, 0.001 * m, 2.0) for m in (0, 10, 20, 110, 120, 180)]
    folder, fill = f"{tmp_path}/job", [(3, m, 0.001 * m, 2.0) for m in range(30, 110, 10)]

    def feed(rows):
        reports(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = detection.follow(spark.readStream.schema(REPORTS).parquet(f"{tmp_path}/in"), folder, RULES)
        return {(x.thing, x.silent_from): x for x in found.collect()}

    first = feed(heard + silent)
    gap = first[3, at(20 * 60)]
    assert (gap.verdict, gap.withdrawn, gap.first_batch, gap.silent_to) == ("dark", False, 0, at(110 * 60)) and len(first) == 2
    again = feed(heard[:5] + silent)
    assert {k: x.changed_batch for k, x in again.items()} == {k: x.changed_batch for k, x in first.items()}
    late = feed(fill)
    assert late[3, at(20 * 60)].withdrawn and late[3, at(20 * 60)].changed_batch == 2 and not late[3, at(120 * 60)].withdrawn
    # what the window has left behind stays as it was
    later = feed([(1, 60 * 40, 3.0, 8.0)])
    assert {k: x.changed_batch for k, x in later.items() if k in late} == {k: x.changed_batch for k, x in late.items()}


@pytest.mark.parametrize(
    ("rel0", "rel1", "near", "seconds", "metres", "knots", "verdict", "score"),
    [
        (0.95, 0.9, 4, 3600.0, 22_000.0, 12.0, "dark", 58.8),
        (0.3, 0.95, 4, 3600.0, 22_000.0, 12.0, "coverage_gap", 5.0),
        (0.95, 0.2, 4, 3600.0, 22_000.0, 12.0, "coverage_gap", 5.0),
        (0.95, 0.95, 0, 3600.0, 22_000.0, 12.0, "coverage_gap", 5.0),
        (0.95, None, 2, 3600.0, None, 12.0, "dark", 54.8),
        (1.0, 1.0, 5, 120.0, 900_000.0, 12.0, "position_jump", 70.0),
        (1.0, 1.0, 3, 21_599.0, 50.0, 0.0, "position_jump", 30.0),
        (1.0, 1.0, 3, 21_601.0, 50.0, 0.0, "dark", 56.0),
        (1.0, 1.0, 3, 2000.0, 6000.0, 0.0, "dark", 51.5),
        (0.1, 0.1, 0, 3600.0, 1_852_000.0, 12.0, "coverage_gap", 41.5),
    ],
)
def test_silences_are_judged_by_coverage_neighbours_and_speed(spark, rel0, rel1, near, seconds, metres, knots, verdict, score):
    facts = spark.createDataFrame([(1, T0, None if metres is None else T0, seconds, metres, knots, rel0, rel1, near)], "thing int, silent_from timestamp, silent_to timestamp, seconds double, metres double, knots0 double, reception_from double, reception_to double, n_near int")
    got = tracks.judged(facts, tracks.Rules()).first()
    assert (got.verdict, got.score) == (verdict, score)


def test_neighbours_across_the_date_line_and_near_the_pole(spark):
    gaps = spark.createDataFrame([(1, T0, 3600.0, 10.0, 179.99, None, None), (2, T0, 3600.0, 89.95, 0.0, None, None), (3, T0, 3600.0, 0.0, 50.0, None, None)], "thing int, silent_from timestamp, seconds double, lat0 double, lon0 double, knots0 double, course0 double")
    seen = [(9, 60, 10.0, -179.95), (8, 60, 10.3, -179.95), (9, 60, 89.9, 180.0), (7, 1700, 89.95, 90.0), (7, 1900, 0.0, 50.0), (3, 60, 0.0, 50.0)]
    others = spark.createDataFrame([(k, at(s), lat, lon, None, None) for k, s, lat, lon in seen], "thing int, ts timestamp, lat double, lon double, knots double, course double")
    got = {x.thing: x.n_near for x in tracks.neighbours(gaps, others, tracks.Rules()).collect()}
    assert got == {1: 1, 2: 2, 3: 0}


def test_only_affected_days_are_rebuilt(spark, tmp_path):
    bronze, target = f"{tmp_path}/bronze", f"{tmp_path}/target"

    def batch(number, rows):
        df = spark.createDataFrame([(i, at(86_400 * day + i), f"v{number}") for i, day in rows], "event_id long, ts timestamp, v string")
        incremental.append_batch(df, bronze, number, F.to_date("ts"))

    def files():
        return {f"{p.parent.name}/{p.name}" for p in tmp_path.glob("target/day=*/*.parquet")}

    batch(1, [(i, i % 4) for i in range(40)])
    assert incremental.rebuild_affected_days(spark, bronze, target, ["event_id"], ["ts"], 0) == 1
    before = files()
    batch(2, [(100, 2), (2, 2), (101, 9)])
    batch(2, [(100, 2), (2, 2), (101, 9)])
    assert incremental.rebuild_affected_days(spark, bronze, target, ["event_id"], ["ts"], 1) == 2
    rows = {x.event_id: x.v for x in spark.read.parquet(target).collect()}
    assert len(rows) == 42 == spark.read.parquet(target).count() and rows[2] == "v1" and rows[100] == "v2"
    kept = {f for f in before if not f.startswith("day=2024-01-03")}
    assert kept <= files() and len(kept) == 3 and not (before - kept) & files()
    assert incremental.rebuild_affected_days(spark, bronze, target, ["event_id"], ["ts"], 2) == 2 and incremental.rebuild_affected_days(spark, bronze, f"{target}2", ["event_id"], ["ts"], 0, upto=1) == 1


def test_runs_are_switched_whole_and_rolled_back(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    frame = lambda n: spark.range(n)
    with pytest.raises(ValueError):
        runs.current(spark, root)
    assert runs.publish_run(frame(1), root, "a") == {"run": "a", "loaded": True, "activated": True, "pruned": []}
    with pytest.raises(ValueError):
        runs.rollback(spark, root)
    reader = runs.current(spark, root)
    runs.publish_run(frame(2), root, "b")
    assert runs.publish_run(frame(9), root, "b") == {"run": "b", "loaded": False, "activated": False, "pruned": []}
    assert (runs.current(spark, root).count(), reader.count()) == (2, 1)
    assert runs.rollback(spark, root) == {"run": "a", "previous": "b"} and runs.current(spark, root).count() == 1
    assert runs.rollback(spark, root) == {"run": "b", "previous": "a"}
    # a run whose load broke off is loaded anew
    frame(3).write.parquet(f"{root}/runs/c")
    (tmp_path / "runs/runs/c/_SUCCESS").unlink()
    assert runs.publish_run(frame(4), root, "c") == {"run": "c", "loaded": True, "activated": True, "pruned": ["a"]}
    assert runs.current(spark, root).count() == 4


def test_no_record_can_end_the_batch(spark, tmp_path):
    good = '{"cid": "1", "source": "s", "received_at": 1, "mmsi": 257000001, "lat": 60.0, "lon": 5, "ts": %s, "msg_type": 1}'
    bodies = [("position", good % t) for t in ("10", "10", "1e400", "9e17", '"x"', "-1", "null", "[]")]
    bodies += [("position", x) for x in (None, "", "null", "{", "[]", '"x"', "{}", "\x00", good[:-1], "9" * 500, '{"a":' * 50, '{"source": "s", "received_at": 1e308, "mmsi": 257000001}')]
    bodies += [("static", '{"source": "s", "received_at": 1e308, "mmsi": 257000001}'), ("static", '{"source": "s", "received_at": 5, "mmsi": 257000001}'), (None, good % "10"), ("dead", "{"), ("dead", '{"cid": "a", "reason": "r", "stage": "sink"}')]
    records = spark.createDataFrame([(t, b, str(i)) for i, (t, b) in enumerate(bodies)], "topic string, body string, cid string")
    landed = sink.Landing(spark, str(tmp_path), F.lit(1e9))
    for _ in range(2):
        landed.absorb(records, 0)
    landed.absorb(records.filter("cid = '0'"), 1)
    told = {x.batch: x for x in landed.table("batches").collect()}
    assert (told[0].records, told[0].positions, told[0].duplicates, told[0].statics, told[0].dead) == (len(bodies), 1, 1, 1, len(bodies) - 3)
    assert (told[1].positions, told[1].duplicates) == (0, 1)
    assert landed.table("positions").count() == 1 and landed.table("dead").filter("reason is null").count() == 0


def test_dead_letters_of_a_batch_are_written_by_all_tasks(spark, tmp_path):
    records = spark.range(0, 4000, 1, 4).selectExpr("'elsewhere' AS topic", "concat('{\"n\": ', id, '}') AS body", "CAST(id AS STRING) AS cid")
    landing = sink.Landing(spark, f"file://{tmp_path}/x")
    landing.absorb(records, 0)
    assert landing.table("dead").count() == 4000
    assert len(list((tmp_path / "x" / "dead" / "batch=0").glob("part-*"))) > 1
