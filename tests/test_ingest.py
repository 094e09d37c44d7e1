"""Sources with real shapes and text functions on odd input: nulls, broken parts, empty tables, actual files."""

import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

from sparkloom.functions import texts
from sparkloom.operators import properties as P
from sparkloom.sources import feeds, files, payloads

SNAP = dt.datetime(2024, 5, 1)


def order(**changed):
    row = {"order_id": 1, "type_id": 34, "price": 5.5, "volume_remain": 3, "volume_total": 10, "is_buy_order": False, "issued": "2024-04-30T10:00:00Z", "duration": 90, "location_id": 7}
    return {k: v for k, v in (row | changed).items() if v != "gone"}


def test_bundles_end_in_one_of_three_outputs(spark):
    page = [order(), order(order_id=1), order(order_id="2", price="7.25", is_buy_order="true"), order(order_id=3, price="gone"), order(order_id=4, price="dear"), order(order_id=5, type_id=35), order(order_id=6, price=0), order(order_id=7, volume_remain=11), order(order_id=8, volume_remain=1.5)]
    page += [order(order_id=9, issued="soon"), order(order_id=10, issued="2024-05-01 02:00:00"), 17, None, "text", [1]]
    answers = [{"type_id": 34, "status": 200, "body": json.dumps(page)}, {"type_id": 35, "status": 503, "body": "x"}, {"type_id": 36, "status": 200, "body": None}, {"type_id": 37}, {"type_id": 38, "status": 200, "body": "{"}, {"type_id": 39, "status": 200, "body": "[]"}, {"type_id": "40", "status": 200}, 5, {"type_id": 99, "status": 200, "body": json.dumps([order(type_id=99)])}]
    rows = [("a", SNAP, "h1", json.dumps(answers)), ("a", SNAP, "h2", "[{"), ("a", SNAP, "h3", '{"type_id": 34}'), ("b", SNAP, "h4", "[]"), ("a", SNAP, "h5", None), (None, SNAP, "h6", "[]"), ("a", SNAP, "h7", "[]")]
    table = spark.createDataFrame(rows, "server_id string, snapshot_ts timestamp, raw_sha string, body string")
    items, servers = spark.createDataFrame([(34,), (35,)], "item_id long"), spark.createDataFrame([("a",)], "server_id string")
    got = payloads.order_bundles(table, items, servers)
    assert sorted((x.order_id, x.price, x.is_buy) for x in got.listings.collect()) == [(1, 5.5, False), (2, 7.25, True)]
    assert sorted((x.item_id, x.status) for x in got.gaps.collect()) == [(35, 503), (36, 200), (37, 0), (38, -1)]
    reasons = sorted((x.raw_sha, x.reason) for x in got.quarantine.collect())
    assert [r for s, r in reasons if s != "h1"] == ["corrupt_payload", "corrupt_payload", "unknown_server", "corrupt_payload", "unknown_server"]
    assert sorted(r for s, r in reasons if s == "h1") == sorted(["duplicate", "missing_field", "bad_type", "type_mismatch", "non_positive_price", "bad_volume", "bad_volume", "bad_timestamp", "bad_timestamp", "bad_type", "bad_type", "bad_type", "bad_type", "unparseable_body", "corrupt_payload", "corrupt_payload", "unknown_item"])
    assert payloads.order_bundles(table.filter("false"), items, servers).quarantine.count() == 0


def test_release_notes_of_a_feed_with_broken_items(spark, tmp_path):
    section = "&lt;h2&gt;Patch Notes for 2024-02-0{}.{}&lt;/h2&gt; &lt;p&gt;a &amp;amp; b&lt;/p&gt;"
    items = [f"<title>Notes - Version 22.01</title><description>intro {section.format(1, 1)} {section.format(1, 3)}</description>", f"<title></title>\n<description>{section.format(2, 1)}</description>", "<title>Sea Expansion: x</title><description>big</description><pubDate>Tue, 05 Mar 2024 11:00:00 GMT</pubDate>", "<title>broken<description>", "<title>Nothing here</title>", "<title>Old Expansion</title><pubDate>never</pubDate>"]
    (tmp_path / "feed.xml").write_text("<rss><channel><title>all</title>" + "".join(f"<item>{i}</item>" for i in items) + "</channel></rss>")
    good, broken = feeds.read_items(spark, str(tmp_path / "feed.xml"))
    assert (good.count(), broken.count()) == (5, 1)
    got = {x.event: x for x in feeds.release_notes(good).collect()}
    assert set(got) == {"2024-02-01.1", "2024-02-01.3", "2024-02-02.1", "exp-sea-expansion"}
    assert (got["2024-02-01.3"].released_at, got["2024-02-01.3"].version, got["2024-02-01.3"].notes) == (dt.datetime(2024, 2, 1, 11, 2), "22.01", "a & b")
    assert got["2024-02-02.1"].title == "Patch 2024-02-02.1" and got["2024-02-02.1"].version is None and got["exp-sea-expansion"].is_major


def test_manifest_of_actual_files(spark, tmp_path):
    for name, data in {"k1/a.txt": b"one", "k1/b.txt": b"one", "k2/c.TXT": b"one", "k1/k2_d.txt": b"two", "k1/k9_e.txt": b"three", "k1/f.csv": b"x", "zz/g.txt": b"y", "k2/h.txt": b"", "i.txt": b"z"}.items():
        path = tmp_path / "set" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    found = files.whole_files(spark, str(tmp_path / "set")).withColumn("path", F.regexp_extract("path", "/(set/.*)$", 1))
    found = found.unionByName(spark.createDataFrame([("set/k2/h.txt", b"")], found.schema))
    classes = spark.createDataFrame([("k1", 1), ("k2", 2)], "class string, label int")
    got = {x.path[4:]: x for x in files.file_set_manifest(found, classes, [".txt"], {"dev": 0.5, "train": 0.5}).collect()}
    assert {k: x.reason for k, x in got.items()} == {"k1/a.txt": None, "k1/b.txt": "duplicate_of:set/k1/a.txt", "k2/c.TXT": "duplicate_of:set/k1/a.txt", "k1/k2_d.txt": "label_conflict:k2", "k1/k9_e.txt": None, "k1/f.csv": "not_wanted", "zz/g.txt": "unknown_class", "k2/h.txt": "empty", "i.txt": "unknown_class"}
    assert got["k1/a.txt"].label == 1 and got["k1/a.txt"].split in ("dev", "train") and got["k1/a.txt"].bytes == 3 and got["k1/b.txt"].split is None


def test_text_is_repaired_and_genuine_latin_text_left_alone(spark):
    right = "la habitación estaba sucia"
    rows = [right.encode().decode("latin-1"), "café déjà vu", right, "a\x00b​c\td\n e", "é", "", None, "漢字 Ã©"]
    got = [x.x for x in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(texts.repair_text(F.col("t")).alias("x")).collect()]
    assert [(x.text, x.repaired) for x in got] == [(right, True), ("café déjà vu", False), (right, False), ("a b c d e", False), ("é", False), ("", False), (None, None), ("漢字 Ã©", False)]


def test_trigram_vectors_are_normalised_and_ignore_spacing(spark):
    rows = [("the room was dirty",), ("the  room was\ndirty ",), ("battery dies fast",), ("",), (None,), ("x" * 100_000,)]
    got = [x.v for x in spark.createDataFrame(rows, "t string").coalesce(1).select(texts.trigram_hash_vector(F.col("t")).alias("v")).collect()]
    assert got[4] is None and all(len(v) == 384 for v in got if v is not None)
    a, b, c_ = (np.array(got[i]) for i in (0, 1, 2))
    assert (a == b).all() and abs(np.linalg.norm(a) - 1) < 1e-9 and a @ c_ < 0.5 and abs(np.linalg.norm(got[5]) - 1) < 1e-9


def test_properties_find_a_pipeline_that_drops_doubles_and_depends_on_order(spark):
    raw = {"t": spark.createDataFrame([(i, float(i)) for i in range(1, 20)], "k long, v double")}
    checks = [lambda r, o, run: P.same_keys("keys", r["t"], "k", o["t"], "k"), lambda r, o, run: P.conserved("total", r["t"], F.col("v"), o["t"], F.col("v"), 0.1), lambda r, o, run: P.same_output("order", o, run(P.reordered(r)))]
    told = lambda plan, tables=raw: {x.property: x.verdict for x in P.check_properties(tables, plan, checks).collect()}
    assert told(lambda t: dict(t)) == {"keys": "held", "total": "held", "order": "held"}
    assert told(lambda t: {"t": t["t"].filter("k != 3")}) == {"keys": "violated", "total": "violated", "order": "held"}
    assert told(lambda t: {"t": t["t"].unionByName(t["t"].filter("k = 3"))})["keys"] == "violated"
    assert told(lambda t: {"t": t["t"].withColumn("v", F.monotonically_increasing_id().cast("double"))})["order"] == "violated"
    assert told(lambda t: dict(t), {"t": raw["t"].filter("false")}) == {"keys": "vacuous", "total": "vacuous", "order": "held"}


def test_parts_of_bundles_are_written_without_the_texts_they_were_read_from(spark):
    """A part is written as typed fields with a text where it is refused only, that of a page not beside each order."""
    page = [order(order_id=k, price=5.5 if k % 10 else 0) for k in range(1, 101)] + [order(order_id=1)]
    table = spark.createDataFrame([("a", SNAP, "h1", json.dumps([{"type_id": 34, "status": 200, "body": json.dumps(page)}, {"type_id": 35, "status": 200, "body": "{"}]))], "server_id string, snapshot_ts timestamp, raw_sha string, body string")
    got = payloads.order_bundles(table, spark.createDataFrame([(34,), (35,)], "item_id long"), spark.createDataFrame([("a",)], "server_id string"))
    refused = {(x.reason, x.raw_row) for x in got.quarantine.collect()}
    assert refused == {("non_positive_price", json.dumps(page[k]).replace(" ", "")) for k in range(9, 100, 10)} | {("duplicate", json.dumps(page[100]).replace(" ", "")), ("unparseable_body", "{")}
    written = spark.read.parquet(*got.listings.inputFiles())
    texts_held = [x for r in written.filter("place is not null and reason is null").collect() for x in r if isinstance(x, str)]
    assert written.count() == 102 and not [n for n in written.columns if n.startswith("raw_") and n != "raw_sha"]
    assert set(texts_held) <= {"a", "h1", "2024-04-30T10:00:00Z"}
