"""Queries of sources with real shapes: bundles, feeds, files, texts to repair, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..functions.scalars import country_digits
from ..operators import properties as P
from ..operators.claims import story_cards
from ..sources import feeds, payloads
from ..sources.files import file_set_manifest
from ..sources.scratch import scratch
from .tables import _t, query

#: Orders of a page from lineitem: some mistyped, too cheap, incomplete, too large, undated, or no objects.
_ORDERS = """SELECT 's' || l_suppkey % 20 AS server_id, date_trunc('month', l_shipdate) AS snapshot_ts, l_partkey % 50 AS item, l_orderkey, l_linenumber, (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS order_id, l_extendedprice AS price, CAST(l_quantity AS BIGINT) AS remain,
 l_suppkey % 20 + l_partkey % 50 + month(l_shipdate) AS mix, l_suppkey % 20 + month(l_shipdate) + year(l_shipdate) AS whole, CASE WHEN l_orderkey % 101 = 0 THEN 'bad_type' WHEN l_orderkey % 37 = 0 THEN 'missing_field' WHEN l_orderkey % 89 = 0 THEN 'bad_type' WHEN l_orderkey % 97 = 0 THEN 'type_mismatch' WHEN l_partkey % 50 = 9 THEN 'unknown_item'
  WHEN l_orderkey % 31 = 0 THEN 'non_positive_price' WHEN l_orderkey % 53 = 0 AND l_quantity > 10 THEN 'bad_volume' WHEN l_orderkey % 61 = 0 THEN 'bad_timestamp' END AS reason FROM lineitem"""


def _bundles(spark, d):
    lines = _t(spark, d, "lineitem")
    rows = spark.sql(_ORDERS.replace("FROM lineitem", "FROM {lines}"), lines=lines)
    c = F.col
    k = c("l_orderkey")
    quoted = F.when(k % 11 == 0, F.concat(F.lit('"'), c("price").cast("string"), F.lit('"'))).otherwise(c("price").cast("string"))
    price = F.when(k % 37 == 0, F.lit("null")).when(k % 89 == 0, F.lit('"dear"')).when(k % 31 == 0, F.lit("0")).otherwise(quoted)
    total = F.when(k % 53 == 0, 10).otherwise(50)
    issued = F.when(k % 61 == 0, F.lit("soon")).otherwise(F.date_format("snapshot_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    order = F.format_string('{"order_id": %d, "type_id": %d, "price": %s, "volume_remain": %d, "volume_total": %d, "is_buy_order": %s, "issued": "%s", "duration": 90}', c("order_id"), c("item") + F.when(k % 97 == 0, 1).otherwise(0), price, c("remain"), total, F.when(k % 2 == 0, "true").otherwise("false"), issued)
    order = F.when(k % 101 == 0, F.lit("17")).otherwise(order)
    told = rows.withColumn("order", F.when((k % 43 == 0) & c("reason").isNull(), F.concat(order, F.lit(", "), order)).otherwise(order))
    pages = told.groupBy("server_id", "snapshot_ts", "item", "mix", "whole").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("order")), ", "), F.lit("]")).alias("page"))
    page = F.when(c("mix") % 17 == 0, F.lit('[{"a": ')).otherwise(c("page"))
    response = F.when(c("mix") % 19 == 0, F.to_json(F.struct(c("item").cast("string").alias("type_id"), F.lit(200).alias("status")))).otherwise(F.to_json(F.struct(c("item").alias("type_id"), F.when(c("mix") % 13 == 0, 404).otherwise(200).alias("status"), page.alias("body"))))
    bundles = pages.groupBy("server_id", "snapshot_ts", "whole").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list(response)), ", "), F.lit("]")).alias("body"))
    body = F.when(c("whole") % 23 == 0, F.lit("[{")).otherwise(c("body"))
    return bundles.select("server_id", "snapshot_ts", F.sha1(F.concat_ws("/", "server_id", c("snapshot_ts").cast("string"))).alias("raw_sha"), body.alias("body"))


@query(f"""WITH o AS ({_ORDERS}), b AS (SELECT *, CASE WHEN server_id = 's7' THEN 'unknown_server' WHEN whole % 23 = 0 THEN 'corrupt_payload' END AS bundle FROM o), p AS (SELECT * FROM b WHERE bundle IS NULL),
 u AS (SELECT DISTINCT server_id, snapshot_ts, item, mix FROM p), g AS (SELECT * FROM p WHERE mix % 19 <> 0 AND mix % 13 <> 0 AND mix % 17 <> 0)
 SELECT DISTINCT server_id, CAST(snapshot_ts AS DATE) AS day, NULL AS item_id, NULL AS order_id, 'quarantine' AS output, bundle AS reason, NULL AS status FROM b WHERE bundle IS NOT NULL
 UNION ALL SELECT server_id, CAST(snapshot_ts AS DATE), NULL, NULL, 'quarantine', 'corrupt_payload', NULL FROM u WHERE mix % 19 = 0
 UNION ALL SELECT server_id, CAST(snapshot_ts AS DATE), item, NULL, 'gap', NULL, CASE WHEN mix % 13 = 0 THEN 404 ELSE -1 END FROM u WHERE mix % 19 <> 0 AND (mix % 13 = 0 OR mix % 17 = 0)
 UNION ALL SELECT server_id, CAST(snapshot_ts AS DATE), item, NULL, 'quarantine', 'unparseable_body', NULL FROM u WHERE mix % 19 <> 0 AND mix % 13 <> 0 AND mix % 17 = 0
 UNION ALL SELECT server_id, CAST(snapshot_ts AS DATE), item, NULL, 'quarantine', reason, NULL FROM g WHERE reason IS NOT NULL
 UNION ALL SELECT server_id, CAST(snapshot_ts AS DATE), item, NULL, 'quarantine', 'duplicate', NULL FROM g WHERE reason IS NULL AND l_orderkey % 43 = 0
 UNION ALL SELECT server_id, CAST(snapshot_ts AS DATE), item, order_id, 'listing', NULL, NULL FROM g WHERE reason IS NULL""")
def S18_order_bundles(spark, d):
    """Snapshots of 20 servers as nested JSON, made from lineitem, flattened to listings, gaps and quarantine."""
    items = spark.range(50).filter("id <> 9").select(F.col("id").alias("item_id"))
    servers = spark.range(20).filter("id <> 7").select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("server_id"))
    out = payloads.order_bundles(_bundles(spark, d), items, servers)
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    key = ["server_id", F.to_date("snapshot_ts").alias("day"), "item_id"]
    listed = out.listings.select(*key, "order_id", F.lit("listing").alias("output"), no("string", "reason"), no("int", "status"))
    gaps = out.gaps.select(*key, no("long", "order_id"), F.lit("gap").alias("output"), no("string", "reason"), "status")
    return listed.unionByName(gaps).unionByName(out.quarantine.select(*key, no("long", "order_id"), F.lit("quarantine").alias("output"), "reason", no("int", "status")))


_SPACES = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _normal(text):
    return f"trim(regexp_replace(nfc_normalize({text}), '{_SPACES}', ' ', 'g'))"


_SEEN = r"regexp_replace(text, '[^\P{C}\n\t]', ' ', 'g')"


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN replace(text, ' ', chr(8203) || ' ' || chr(7)) ELSE text END AS text FROM documents)
 SELECT doc_id, sha256({_normal(_SEEN)}) AS text_sha256, doc_id % 5 = 0 AND regexp_matches(text, '[^\\x00-\\x7F]') AS repaired FROM d""")
def F04_repair_text(spark, d):
    """A fifth of the documents decoded with the wrong codec, a seventh with control characters, repaired."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    text = F.when(F.col("doc_id") % 7 == 0, F.replace("text", F.lit(" "), F.lit("​ \u0007"))).otherwise(F.col("text"))
    wrong = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    told = docs.select("doc_id", texts.repair_text(F.when(F.col("doc_id") % 5 == 0, wrong).otherwise(text)).alias("x"))
    return told.select("doc_id", F.sha2(F.encode("x.text", "UTF-8"), 256).alias("text_sha256"), "x.repaired")


_W1, _W2, _W3 = texts.WEIGHTS


@query(f"""WITH t AS (SELECT doc_id, '  ' || lower({_normal('text')}) || '  ' AS t FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, list_transform(string_split(t, ''), lambda x: unicode(x)::BIGINT) AS u FROM t),
 h AS (SELECT doc_id, unnest(list_transform(list_zip(u[:-3], u[2:-2], u[3:]), lambda z: (z[1] * {_W1} + z[2] * {_W2} + z[3] * {_W3}) % {texts.PRIME})) AS h FROM u), s AS (SELECT doc_id, h % 384 AS bucket, sum(CASE WHEN h // 384 % 2 = 1 THEN 1 ELSE -1 END) AS n FROM h GROUP BY 1, 2),
 l AS (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS size FROM s) SELECT doc_id, CAST(bucket AS INT) AS bucket, round(n / size, 6) AS weight FROM l WHERE n <> 0""")
def F17_trigram_hash_vector(spark, d):
    docs = _t(spark, d, "documents").filter("text is not null").select("doc_id", F.posexplode(texts.trigram_hash_vector(F.col("text"))).alias("bucket", "w"))
    return docs.filter("w != 0").select("doc_id", "bucket", F.round("w", 6).alias("weight"))


_MONTH = "CAST(date_trunc('month', o_orderdate) AS DATE)"
_RELEASES = f"SELECT {_MONTH} AS m, CAST(o_orderdate AS DATE) AS day, o_custkey % 2 + 1 AS part, min(o_orderkey) AS low, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1, 2, 3"


@query(f"""WITH r AS ({_RELEASES}), i AS (SELECT DISTINCT m, month(m) AS k, year(m) AS y FROM r) SELECT strftime(day, '%Y-%m-%d') || '.' || part AS event, day + INTERVAL 11 HOUR + INTERVAL 1 MINUTE * (part - 1) AS released_at, CASE WHEN month(m) % 4 <> 1 THEN year(m) % 100 || '.' || lpad(CAST(month(m) AS VARCHAR), 2, '0') END AS version,
 CASE WHEN month(m) % 4 = 1 THEN 'Patch ' || strftime(day, '%Y-%m-%d') || '.' || part ELSE 'Patch Notes - Version ' || year(m) % 100 || '.' || lpad(CAST(month(m) AS VARCHAR), 2, '0') || ' · ' || strftime(day, '%Y-%m-%d') || '.' || part END AS title, 'Fixed ' || n || ' orders & "more" from ' || low AS notes, false AS is_major FROM r WHERE month(m) % 5 <> 3 AND month(m) <> 12
 UNION ALL SELECT 'exp-great-expansion-' || y, m + INTERVAL 6 HOUR, NULL, 'Great Expansion ' || y || ': Notes', 'All new', true FROM i WHERE k = 12""")
def S15_release_notes(spark, d):
    """A feed made from orders: a release each month with sections by day, expansions in December, and every fifth month
    broken."""
    orders, c = _t(spark, d, "orders"), F.col
    sections = spark.sql(_RELEASES.replace("FROM orders", "FROM {orders}"), orders=orders)
    strong = F.when(c("part") == 2, "<strong>").otherwise(""), F.when(c("part") == 2, "</strong>").otherwise("")
    section = F.concat(F.lit('<h2 class="x">'), strong[0], F.lit("Patch Notes for "), F.date_format("day", "yyyy-MM-dd"), F.lit("."), c("part").cast("string"), strong[1], F.lit("</h2><p>Fixed <b>"), c("n").cast("string"), F.lit("</b>\n orders &amp; &quot;more&quot;</p> from&nbsp;"), c("low").cast("string"))
    items = sections.groupBy("m").agg(F.array_join(F.sort_array(F.collect_list(section)), "\n").alias("sections"))
    year = F.year("m").cast("string")
    last = F.month("m") == 12
    title = F.when(last, F.concat(F.lit("Great Expansion "), year, F.lit(": Notes"))).when(F.month("m") % 4 == 1, F.lit("")).otherwise(F.concat(F.lit("Patch Notes - Version "), F.date_format("m", "yy").cast("int").cast("string"), F.lit("."), F.date_format("m", "MM")))
    body = F.when(last, "<p>All  new</p>").otherwise(c("sections"))
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        body = F.replace(body, F.lit(plain), F.lit(entity))
    made = F.concat(F.lit("<item><title>"), title, F.when(F.month("m") % 5 == 3, "</titel>").otherwise("</title>"), F.lit("<description>"), body, F.lit("</description><pubDate>"), F.date_format("m", "EEE, dd MMM yyyy"), F.lit(" 08:00:00 +0200</pubDate></item>"))
    path = scratch(spark)
    items.select(made.alias("value")).write.text(path)
    notes = feeds.release_notes(feeds.read_items(spark, path)[0])
    return notes.withColumn("released_at", F.to_timestamp_ntz(F.date_format("released_at", "yyyy-MM-dd HH:mm:ss")))


_FILES = """SELECT doc_id, 'set/' || CASE WHEN doc_id % 29 = 0 THEN 'other' ELSE 'k' || doc_id % 4 END || '/' || CASE WHEN doc_id % 31 = 0 THEN 'k' || (doc_id + 1) % 4 || '_' WHEN doc_id % 3 = 0 THEN 'k' || doc_id % 4 || '_' ELSE 'n_' END || lpad(CAST(doc_id AS VARCHAR(20)), 9, '0') || CASE WHEN doc_id % 37 = 0 THEN '.csv' ELSE '.TXT' END AS path, text FROM documents"""


@query(f"""WITH f AS (SELECT path, CASE WHEN doc_id % 41 = 0 THEN '' ELSE coalesce(text, '') END AS text, doc_id FROM ({_FILES})), r AS (SELECT *, sha1(text) AS sha1, CASE WHEN doc_id % 37 = 0 THEN 'not_wanted' WHEN doc_id % 29 = 0 THEN 'unknown_class' WHEN doc_id % 31 = 0 THEN 'label_conflict:k' || (doc_id + 1) % 4 WHEN text = '' THEN 'empty' END AS own FROM f),
 d AS (SELECT *, min(path) FILTER (own IS NULL) OVER (PARTITION BY sha1) AS first FROM r), x AS (SELECT *, coalesce(own, CASE WHEN first < path THEN 'duplicate_of:' || first END) AS reason, CAST('0x' || substr(sha1(string_split(path, '/')[3]), 1, 8) AS BIGINT) / 4294967296 AS draw FROM d)
 SELECT path, CASE WHEN reason IS NULL THEN CAST(doc_id % 4 AS INT) END AS label, CASE WHEN reason IS NULL THEN CASE WHEN draw < 0.08 THEN 'dev' WHEN draw < 0.12 THEN 'calib' ELSE 'train' END END AS split, sha1, octet_length(encode(text)) AS bytes, reason FROM x""")
def S16_file_set_manifest(spark, d):
    """Documents as files of four classes, some misplaced, unwanted, empty or copies of others."""
    files = spark.sql(_FILES.replace("VARCHAR(20)", "STRING").replace("FROM documents", "FROM {docs}"), docs=_t(spark, d, "documents"))
    content = F.encode(F.when(F.col("doc_id") % 41 == 0, "").otherwise(F.coalesce("text", F.lit(""))), "UTF-8")
    classes = spark.createDataFrame([(f"k{i}", i) for i in range(4)], "class string, label int")
    return file_set_manifest(files.select("path", content.alias("content")), classes, [".txt"], {"dev": 0.08, "calib": 0.04, "train": 0.88})


_METHODS = ("A", "N", "R")


def shop(tables):
    """orders with an amount for each method of payment, and customers with their orders' count, span and value."""
    c = F.col
    paid = tables["payments"].groupBy("order_id").agg(*(F.sum(F.when(c("method") == m, c("cents"))).alias(f"{m}_cents") for m in _METHODS), F.sum("cents").alias("cents"))
    orders = tables["orders"].join(paid, "order_id", "left")
    orders = orders.select("order_id", "customer_id", "day", *((F.coalesce(f"{m}_cents", F.lit(0)) / 100).alias(f"{m}_amount") for m in _METHODS), (c("cents") / 100).alias("amount"))
    sums = orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_orders"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("amount").alias("value"))
    return {"orders": orders, "customers": tables["customers"].join(sums, "customer_id", "left")}


def _one_more(raw, out, pipeline):
    target = raw["orders"].agg(F.min("order_id")).first()[0]
    extra = raw["payments"].sparkSession.range(1).select(F.lit(target).cast("long").alias("order_id"), F.lit("A").alias("method"), F.lit(100).cast("long").alias("cents"))
    after = pipeline({**raw, "payments": raw["payments"].unionByName(extra)})
    return P.change_is_local("one_more_payment_is_local", out["orders"], after["orders"], "order_id", "amount", target, 1.0, 1e-6)


_SHOP_CHECKS = [
    lambda raw, out, run: P.same_keys("orders_one_row_per_raw_order", raw["orders"], "order_id", out["orders"], "order_id"),
    lambda raw, out, run: P.same_keys("customers_one_row_per_raw_customer", raw["customers"], "customer_id", out["customers"], "customer_id"),
    lambda raw, out, run: P.never("orders_amount_not_null", out["orders"], F.col("amount").isNull()),
    lambda raw, out, run: P.never("orders_method_amounts_not_null", out["orders"], F.expr(" or ".join(f"{m}_amount is null" for m in _METHODS))),
    lambda raw, out, run: P.conserved("cents_conserved", raw["payments"], F.col("cents"), out["orders"], F.col("amount") * 100, 0.5),
    lambda raw, out, run: P.never("methods_sum_to_amount", out["orders"], F.expr("abs(" + " + ".join(f"{m}_amount" for m in _METHODS) + " - amount) > 1e-6"), F.col("amount").isNotNull()),
    lambda raw, out, run: P.conserved("value_is_sum_of_orders", out["orders"], F.col("amount"), out["customers"], F.col("value"), 0.01),
    lambda raw, out, run: P.never("first_order_before_last", out["customers"], F.col("first_day") > F.col("last_day"), F.col("first_day").isNotNull()),
    lambda raw, out, run: P.never("refunds_are_negative", out["orders"], F.col("amount") >= 0, F.col("order_id") < 0),
    lambda raw, out, run: P.same_output("deterministic", out, run(raw), 3),
    lambda raw, out, run: P.same_output("row_order_invariant", out, run(P.reordered(raw)), 3),
    _one_more,
]


@query("""WITH p AS (SELECT l_orderkey AS o, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1), a AS (SELECT o_orderkey, cents FROM orders LEFT JOIN p ON o = o_orderkey),
 s AS (SELECT (SELECT sum(cents) FROM p) AS was, (SELECT sum(cents) FROM a) AS is_, (SELECT count(*) FROM a WHERE cents IS NULL) AS missing, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS strangers)
 SELECT unnest(['orders_one_row_per_raw_order', 'customers_one_row_per_raw_customer', 'orders_amount_not_null', 'orders_method_amounts_not_null', 'cents_conserved', 'methods_sum_to_amount', 'value_is_sum_of_orders', 'first_order_before_last', 'refunds_are_negative', 'deterministic', 'row_order_invariant', 'one_more_payment_is_local']) AS property,
 unnest(['held', 'held', CASE WHEN missing > 0 THEN 'violated' ELSE 'held' END, 'held', CASE WHEN was = is_ THEN 'held' ELSE 'violated' END, 'held', CASE WHEN strangers > 0 THEN 'violated' ELSE 'held' END, 'held', 'vacuous', 'held', 'held', 'held']) AS verdict FROM s""")
def M26_check_properties(spark, d):
    """A shop's pipeline over orders and line items as payments, of which a seventh of the orders has none."""
    raw = {
        "customers": _t(spark, d, "customer").select(F.col("c_custkey").alias("customer_id")),
        "orders": _t(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.to_date("o_orderdate").alias("day")),
        "payments": _t(spark, d, "lineitem").filter("l_orderkey % 7 != 0").select(F.col("l_orderkey").alias("order_id"), F.col("l_returnflag").alias("method"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")),
    }
    return P.check_properties(raw, shop, _SHOP_CHECKS)


#: A second provider's documents made from events.
_PROVIDER = """CASE WHEN event_id % 41 = 0 THEN '{' WHEN event_type = 'error' THEN '{"MessageType": "Unknown", "Message": {}}' WHEN event_type = 'signup' THEN concat('{"MessageType": "ShipStaticData", "Message": {"ShipStaticData": {"UserID": ', 200000000 + user_id, ', "Name": "', CASE WHEN event_id % 3 = 0 THEN '  ' ELSE ' SHIP ' END, '", "ImoNumber": ', event_id % 5, ', "Dimension": {"A": ', event_id % 90, '}}}}')
 ELSE concat('{"MessageType": "', CASE WHEN event_type = 'view' THEN 'StandardClassBPositionReport' ELSE 'PositionReport' END, '", "MetaData": {"time_utc": "2024-01-0', 1 + event_id % 9, ' 10:20:', 30 + event_id % 30, '.318353 +0000 UTC"}, "Message": {"', CASE WHEN event_type = 'view' THEN 'StandardClassBPositionReport' ELSE 'PositionReport' END, '": {"UserID": ', 200000000 + user_id, ', "Latitude": ', event_id % 80, '.5, "Longitude": 10, "Sog": ',
  CASE WHEN event_id % 7 = 0 THEN '102.3' ELSE '7.5' END, ', "Cog": ', event_id * 11 % 400, ', "TrueHeading": ', CASE WHEN event_id % 6 = 0 THEN 511 ELSE event_id % 360 END, ', "Timestamp": ', event_id * 7 % 64, '}}}') END"""


@query("""WITH e AS (SELECT *, event_id % 41 <> 0 AND event_type IN ('view', 'click', 'purchase') AS pos, event_id % 41 <> 0 AND event_type = 'signup' AS sta, epoch(TIMESTAMP '2024-01-01 10:20:00')::BIGINT + 86400 * (event_id % 9) + 30 + event_id % 30 AS heard, event_id * 7 % 64 AS sec FROM events)
 SELECT event_id, CASE WHEN pos THEN 'position' WHEN sta THEN 'static' END AS kind, CASE WHEN pos THEN CASE WHEN event_type = 'view' THEN 18 ELSE 1 END WHEN sta THEN 5 END AS msg_type, CASE WHEN pos OR sta THEN 200000000 + user_id END AS mmsi, CASE WHEN pos THEN event_id % 80 + 0.5 END::DOUBLE AS lat, CASE WHEN pos THEN 10.0 END::DOUBLE AS lon,
 CASE WHEN pos AND event_id % 7 <> 0 THEN 7.5 END::DOUBLE AS sog, CASE WHEN pos AND event_id * 11 % 400 < 360 THEN event_id * 11 % 400 END::DOUBLE AS cog, CASE WHEN pos AND event_id % 6 <> 0 THEN event_id % 360 END::DOUBLE AS heading, CASE WHEN pos THEN CASE WHEN sec BETWEEN 0 AND 59 THEN heard - ((heard + 5 - sec) % 60 + 60) % 60 + 5 ELSE heard END END AS ts,
 CASE WHEN sta AND event_id % 3 <> 0 THEN 'SHIP' END AS name, CASE WHEN sta AND event_id % 5 <> 0 THEN event_id % 5 END AS imo, CASE WHEN sta THEN CAST(event_id % 90 AS INT) END AS to_bow, NULL::DOUBLE AS draught FROM e""")
def S17_normalise_provider_json(spark, d):
    docs = _t(spark, d, "events").selectExpr("event_id", f"{_PROVIDER} AS doc")
    return feeds.normalise_provider_json(docs, "doc").drop("doc")


@query("SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) - 1 AS INT) AS position, event_type AS card FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)")
def S12_publish_cards(spark, d):
    """Each user's kinds of events, most frequent first, as a list, published as rows."""
    counts = _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    stories = counts.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "event_type"))).alias("x")).select("user_id", F.col("x.event_type").alias("cards"))
    return story_cards(stories, "user_id", "cards")


@query("SELECT event_id, n_name AS flag FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN user_id ELSE (200 + user_id % 40) * 1000000 + user_id END AS id FROM events) LEFT JOIN nation ON n_nationkey + 200 = id // 1000000 AND id BETWEEN 100000000 AND 999999999")
def F19_flag_of(spark, d):
    """Vessel numbers made from events; nations stand for countries, whose digits are 200 and the nation's key."""
    ids = _t(spark, d, "events").selectExpr("event_id", "CASE WHEN event_id % 9 = 0 THEN user_id ELSE (200 + user_id % 40) * 1000000 + user_id END AS id")
    flags = _t(spark, d, "nation").select((F.col("n_nationkey") + 200).alias("digits"), F.col("n_name").alias("flag"))
    return ids.withColumn("digits", country_digits(F.col("id"))).join(flags, "digits", "left").select("event_id", "flag")
