"""Queries of the rule sets over views of the given tables with planted defects, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rulesets as R
from ..operators import validation as V
from .tables import _rules, _t, query

_LINES = "NOT (l_quantity BETWEEN 1 AND 45) OR l_discount > 0.09 OR l_returnflag = 'R'"


@query(f"SELECT count(*) AS landed, count(*) FILTER (NOT ({_LINES})) AS clean, count(*) FILTER ({_LINES}) - 1 AS quarantined, 1 AS lost, 0 AS invented FROM lineitem")
def V04_account_rows(spark, d):
    """One quarantined row is lost on purpose: the last of the table."""
    lines = _t(spark, d, "lineitem")
    valid, bad = V.split_valid(lines, _rules())
    last = bad.agg(F.max(F.struct("l_orderkey", "l_linenumber")).alias("x")).select("x.*")
    return R.account_rows(lines, valid, bad.join(last, ["l_orderkey", "l_linenumber"], "left_anti"))


@query("""SELECT name, CAST(expected AS DOUBLE) AS expected, CAST(actual AS DOUBLE) AS actual FROM (SELECT 'events' AS name, (SELECT count(*) FROM events) * 1.0 AS expected, (SELECT sum(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id, CAST(ts AS DATE))) * 1.0 AS actual
 UNION ALL SELECT 'users', (SELECT count(DISTINCT user_id) FROM events), (SELECT count(DISTINCT user_id) FROM events WHERE event_type <> 'error')
 UNION ALL SELECT 'purchases', (SELECT count(*) FROM events WHERE event_type = 'purchase'), (SELECT count(*) FROM events WHERE event_type = 'purchase' AND value >= 1)
 UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(DISTINCT l_orderkey) FROM lineitem)
 UNION ALL SELECT 'customers', (SELECT count(*) FROM customer), (SELECT count(DISTINCT o_custkey) FROM orders)
 UNION ALL SELECT 'nations', (SELECT count(*) FROM nation), (SELECT count(DISTINCT c_nationkey) FROM customer)
 UNION ALL SELECT 'regions', (SELECT count(*) FROM region), (SELECT count(DISTINCT n_regionkey) FROM nation)) WHERE expected IS DISTINCT FROM actual""")
def V06_reconcile_layers(spark, d):
    ev, n = _t(spark, d, "events"), F.count(F.lit(1))
    count = lambda df: df.agg(n)
    of = lambda t, col: _t(spark, d, t).agg(F.count_distinct(col))
    days = ev.groupBy("user_id", F.to_date("ts")).agg(n.alias("n")).agg(F.sum("n"))
    return R.reconcile_layers([
        ("events", count(ev), days),
        ("users", of("events", "user_id"), ev.filter("event_type <> 'error'").agg(F.count_distinct("user_id"))),
        ("purchases", count(ev.filter("event_type = 'purchase'")), count(ev.filter("event_type = 'purchase' AND value >= 1"))),
        ("orders", count(_t(spark, d, "orders")), of("lineitem", "l_orderkey")),
        ("customers", count(_t(spark, d, "customer")), of("orders", "o_custkey")),
        ("nations", count(_t(spark, d, "nation")), of("customer", "c_nationkey")),
        ("regions", count(_t(spark, d, "region")), of("nation", "n_regionkey")),
    ])


_SHOP = """SELECT CASE WHEN o_orderkey % 97 = 0 THEN o_orderkey - 1 ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN o_custkey + 100000000 ELSE o_custkey END AS user_id,
 CASE WHEN o_orderkey % 23 = 0 THEN 'x' || CAST(o_orderkey AS VARCHAR(20)) ELSE CAST(o_totalprice AS VARCHAR(40)) END AS amount, o_orderstatus AS status FROM orders"""


@query(f"""WITH s AS ({_SHOP}), m AS (SELECT *, count(*) OVER (PARTITION BY id) AS times FROM s)
 SELECT id, 'missing_user_id' AS broken FROM m WHERE user_id IS NULL UNION ALL SELECT id, 'type_amount' FROM m WHERE amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL
 UNION ALL SELECT id, 'not_accepted_status' FROM m WHERE status NOT IN ('O', 'F') UNION ALL SELECT id, 'duplicate_id' FROM m WHERE times > 1
 UNION ALL SELECT id, 'dangling_user_id' FROM m WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT c_custkey FROM customer)""")
def V07_check_constraints(spark, d):
    _t(spark, d, "orders").createOrReplaceTempView("_v07_orders")
    shop = spark.sql(_SHOP.replace("FROM orders", "FROM _v07_orders"))
    parents = {"user_id": _t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))}
    return R.check_constraints(shop, "id", ["user_id"], {"amount": "double"}, {"status": ["O", "F"]}, parents)


_POSITIONS = [
    "event_id", "ts", "user_id",
    "CASE WHEN event_id % 17 = 0 THEN user_id WHEN event_id % 43 = 0 THEN NULL ELSE user_id + 200000000 END AS id",
    "CASE WHEN event_id % 50 = 0 THEN 91.0 WHEN event_id % 61 = 0 THEN 0.0 ELSE (event_id * 37 % 18300) / 100.0 - 91.5 END AS lat",
    "CASE WHEN event_id % 50 = 0 THEN 181.0 WHEN event_id % 61 = 0 THEN 0.0005 ELSE (event_id * 53 % 36400) / 100.0 - 182 END AS lon",
]
_NOW = "2024-01-25 00:00:00"


@query(f"""SELECT event_id, CASE WHEN id IS NULL THEN 'missing_id' WHEN NOT id BETWEEN 200000000 AND 799999999 THEN 'bad_id' WHEN lat = 91 OR lon = 181 THEN 'no_position' WHEN abs(lat) > 90 OR abs(lon) > 180 THEN 'out_of_range'
 WHEN abs(lat) < 0.001 AND abs(lon) < 0.001 THEN 'null_island' WHEN ts > TIMESTAMP '{_NOW}' + INTERVAL 120 SECOND THEN 'in_the_future' END AS reason FROM (SELECT {", ".join(_POSITIONS)} FROM events)""")
def V08_validate_position(spark, d):
    rows = _t(spark, d, "events").selectExpr(*_POSITIONS)
    return rows.select("event_id", V.first_failure(R.positions(F.lit(_NOW).cast("timestamp_ntz"))).alias("reason"))


_DIGITS = " + ".join(f"(o_orderkey // {10 ** (6 - k)} % 10) * {7 - k}" for k in range(6))


@query(f"SELECT o_orderkey, o_orderkey < 10000000 AND ({_DIGITS}) % 10 = o_orderkey % 10 AS valid FROM orders")
def V09_check_digit(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", R.check_digit(F.col("o_orderkey"), 7).alias("valid"))


@query("""SELECT event_id, CASE WHEN user_id IS NULL THEN 'missing_user_id' WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup') THEN 'unknown_type'
 WHEN NOT ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-28' THEN 'time_out_of_range' END AS reason FROM (SELECT event_id, CASE WHEN event_id % 41 = 0 THEN NULL ELSE user_id END AS user_id, event_type, ts FROM events)""")
def V11_validate_events(spark, d):
    rows = _t(spark, d, "events").withColumn("user_id", F.when(F.col("event_id") % 41 != 0, F.col("user_id")))
    day = lambda s: F.lit(s).cast("timestamp_ntz")
    return rows.select("event_id", V.first_failure(R.events(["view", "click", "purchase", "signup"], day("2024-01-02 00:00:00"), day("2024-01-28 00:00:00"))).alias("reason"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_orderkey % 37 = 0 THEN 0 ELSE l_extendedprice END AS price, l_quantity AS volume, CASE WHEN l_orderkey % 53 = 0 THEN 10.0 ELSE 50.0 END AS total FROM lineitem),
 s AS (SELECT l.*, p.p_partkey IS NOT NULL AS known, row_number() OVER (PARTITION BY l_partkey, day ORDER BY l_orderkey, l_linenumber) AS seen FROM l LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) p ON p_partkey = l_partkey)
 SELECT l_orderkey, l_linenumber, CASE WHEN NOT known THEN 'unknown_item' WHEN NOT price > 0 THEN 'bad_price' WHEN NOT volume > 0 OR volume > total THEN 'bad_volume' WHEN seen > 1 THEN 'duplicate_in_snapshot' END AS reason FROM s""")
def V12_validate_listings(spark, d):
    lines = _t(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "CAST(l_shipdate AS DATE) AS day", "CASE WHEN l_orderkey % 37 = 0 THEN 0 ELSE l_extendedprice END AS price", "l_quantity AS volume", "CASE WHEN l_orderkey % 53 = 0 THEN 10.0 ELSE 50.0 END AS total")
    items = _t(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").alias("l_partkey"))
    return R.listings(lines, items, "l_partkey", "price", "volume", "total", ["l_partkey", "day"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "reason")


_HISTORY = "CAST(o_orderdate AS DATE) AS day, min(o_totalprice) AS low, avg(o_totalprice) * CASE WHEN day(max(o_orderdate)) % 7 = 0 THEN 3 ELSE 1 END AS average, max(o_totalprice) AS high"


@query(f"""SELECT day, CASE WHEN NOT low > 0 THEN 'bad_price' WHEN NOT (low <= average AND average <= high) THEN 'inconsistent_range' WHEN day > DATE '2001-01-01' THEN 'day_after_fetch' END AS reason
 FROM (SELECT {_HISTORY} FROM orders GROUP BY 1)""")
def V13_validate_history(spark, d):
    price = F.col("o_totalprice")
    days = _t(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.min(price).alias("low"), (F.avg(price) * F.when(F.day(F.max("o_orderdate")) % 7 == 0, 3).otherwise(1)).alias("average"), F.max(price).alias("high"))
    return days.withColumn("fetched", F.lit("2001-01-01").cast("date")).select("day", V.first_failure(R.history("day", "low", "average", "high", "fetched")).alias("reason"))


@query("""SELECT event_id, CASE WHEN value IS NULL THEN 'missing_value' WHEN event_type NOT IN ('purchase', 'signup', 'view') THEN 'unknown_kind' WHEN isnan(value) OR isinf(value) THEN 'not_finite' WHEN value < 0 THEN 'negative' END AS reason
 FROM (SELECT event_id, event_type, CASE WHEN event_id % 19 = 0 THEN -value WHEN event_id % 47 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 59 = 0 THEN NULL ELSE value END AS value FROM events)""")
def V15_validate_flows(spark, d):
    value = F.when(F.col("event_id") % 19 == 0, -F.col("value")).when(F.col("event_id") % 47 == 0, float("nan")).when(F.col("event_id") % 59 != 0, F.col("value"))
    return _t(spark, d, "events").withColumn("value", value).select("event_id", V.first_failure(R.flows("event_type", ["purchase", "signup", "view"], "value")).alias("reason"))


_UNIT = ["event_id", "CASE event_id % 5 WHEN 0 THEN ' Yes' WHEN 1 THEN 'F' WHEN 2 THEN '1' WHEN 3 THEN 'no ' ELSE 'perhaps' END AS treated", "CASE event_id % 3 WHEN 0 THEN '$1,' || CAST(100 + event_id % 900 AS VARCHAR(9)) || '.50' WHEN 1 THEN CAST(event_id AS VARCHAR(20)) ELSE 'n/a' END AS spent"]


@query(f"""SELECT event_id, CASE WHEN lower(trim(treated)) IN ('1', 'true', 't', 'yes', 'y') THEN true WHEN lower(trim(treated)) IN ('0', 'false', 'f', 'no', 'n') THEN false END AS treated,
 TRY_CAST(regexp_replace(spent, '[$€£,\\s]', '', 'g') AS DOUBLE) AS spent FROM (SELECT {", ".join(_UNIT)} FROM events)""")
def V16_normalise_units(spark, d):
    return _t(spark, d, "events").selectExpr(*_UNIT).select("event_id", R.truth(F.col("treated")).alias("treated"), R.money(F.col("spent")).alias("spent"))


@query("""SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'missing_text' WHEN source IS NULL OR trim(source) = '' THEN 'missing_source' WHEN length(text) > 4000 THEN 'too_long' WHEN NOT regexp_matches(source, '^[a-z][a-z0-9_.-]{0,40}$') THEN 'bad_source'
 WHEN NOT regexp_matches(lang, '^[a-z]{2}(-[A-Z]{2})?$') THEN 'bad_language' WHEN created_at > TIMESTAMP '2024-02-02' THEN 'in_the_future' END AS reason
 FROM (SELECT doc_id, text, CASE WHEN doc_id % 13 = 0 THEN upper(lang) ELSE lang END AS lang, CASE WHEN doc_id % 11 = 0 THEN 'Bad Source' ELSE 'feed.' || CAST(doc_id % 7 AS VARCHAR) END AS source, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (doc_id % 40) AS created_at FROM documents)""")
def V18_validate_feedback(spark, d):
    docs = _t(spark, d, "documents").selectExpr("doc_id", "text", "CASE WHEN doc_id % 13 = 0 THEN upper(lang) ELSE lang END AS lang", "CASE WHEN doc_id % 11 = 0 THEN 'Bad Source' ELSE concat('feed.', doc_id % 7) END AS source", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(doc_id % 40 AS INT)) AS created_at")
    return docs.select("doc_id", V.first_failure(R.feedback(F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))).alias("reason"))


@query("""WITH s AS (SELECT event_id, user_id, event_type, row_number() OVER w AS n, first_value(event_type) OVER w AS first_type FROM (SELECT event_id, event_type, CASE WHEN event_id % 71 <> 0 THEN user_id END AS user_id FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
 SELECT event_id, CASE WHEN user_id IS NULL THEN 'quarantined' WHEN n = 1 THEN 'created' WHEN event_type = first_type THEN 'duplicate' ELSE 'conflict' END AS verdict FROM s""")
def V24_classify_submission(spark, d):
    rows = _t(spark, d, "events").withColumn("user_id", F.when(F.col("event_id") % 71 != 0, F.col("user_id")))
    return R.delivery_conflicts(rows, "user_id", "event_type", "event_id").select("event_id", "verdict")


@query("""WITH s AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 5 = 0 AS test FROM documents), f AS (SELECT text, min(doc_id) FILTER (NOT test) AS pool, min(doc_id) FILTER (test) AS leaked_from FROM s GROUP BY 1)
 SELECT doc_id, leaked_from, CASE WHEN pool <> doc_id THEN pool END AS copy_of FROM s JOIN f USING (text) WHERE NOT test AND (leaked_from IS NOT NULL OR pool <> doc_id)""")
def V20_copies_and_leakage(spark, d):
    docs = _t(spark, d, "documents").withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("pool"))
    return R.copies_and_leakage(docs, "doc_id", "text", "split")


_LINE = [
    "CAST(o_orderkey AS VARCHAR(20)) AS order_ref", "CASE WHEN o_orderkey % 21 = 0 THEN 'nobody' ELSE 'u' || CAST(o_custkey AS VARCHAR(20)) || '@shop.example' END AS email", "CASE WHEN o_orderkey % 34 = 0 THEN 'Germany' ELSE 'DE' END AS country",
    "CASE o_orderstatus WHEN 'O' THEN ' Open' WHEN 'F' THEN 'shipped' ELSE 'weird' END AS status", "CASE WHEN o_orderkey % 45 = 0 THEN 'free' WHEN o_orderkey % 46 = 0 THEN '-5' ELSE '€ ' || CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR(30)) END AS amount",
    "CASE WHEN o_orderkey % 55 = 0 THEN 'XYZ' WHEN o_orderkey % 2 = 0 THEN 'USD' END AS currency",
]
_PLACED = "CASE o_orderkey % 4 WHEN 0 THEN {iso} WHEN 1 THEN {slash} WHEN 2 THEN {epoch} ELSE 'yesterday' END AS placed_at"


@query(f"""WITH s AS (SELECT {", ".join(_LINE)}, o_orderkey % 4 AS layout, o_orderdate FROM orders), p AS (SELECT *, CASE trim(lower(status)) WHEN 'open' THEN 'open' WHEN 'shipped' THEN 'done' END AS known, TRY_CAST(regexp_replace(amount, '[$€£,\\s]', '', 'g') AS DOUBLE) AS value FROM s)
 SELECT order_ref, known AS status, CASE WHEN email = 'nobody' THEN 'bad_email' WHEN country = 'Germany' THEN 'bad_country' WHEN known IS NULL THEN 'unknown_status' WHEN value IS NULL THEN 'bad_amount' WHEN value < 0 THEN 'negative_amount'
 WHEN currency = 'XYZ' THEN 'unknown_currency' WHEN layout = 3 THEN 'bad_time' WHEN o_orderdate > TIMESTAMP '2001-01-01' THEN 'in_the_future' END AS reason FROM p""")
def V21_validate_orders(spark, d):
    placed = _PLACED.format(iso="date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\")", slash="date_format(o_orderdate, 'yyyy/MM/dd')", epoch="CAST(unix_timestamp(CAST(o_orderdate AS TIMESTAMP)) AS STRING)")
    lines = _t(spark, d, "orders").selectExpr(*_LINE, placed)
    status, _, rules = R.orders({"open": "open", "shipped": "done"}, ["EUR", "USD"], F.lit("2001-01-01 00:00:00").cast("timestamp"))
    return lines.select("order_ref", status.alias("status"), V.first_failure(rules).alias("reason"))


@query("""SELECT event_id, CASE WHEN kind IS NULL THEN 'missing_kind' WHEN kind NOT IN ('click', 'purchase') THEN 'unknown_kind' WHEN TRY_CAST(quantity AS BIGINT) IS NULL THEN 'quantity_not_a_number' WHEN NOT TRY_CAST(quantity AS BIGINT) BETWEEN 1 AND 6 THEN 'quantity_out_of_range' END AS reason
 FROM (SELECT event_id, CASE WHEN event_id % 33 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 8 = 0 THEN 'two' ELSE CAST(event_id % 9 AS VARCHAR) END AS quantity FROM events)""")
def V22_validate_attempts(spark, d):
    rows = _t(spark, d, "events").selectExpr("event_id", "user_id", "CASE WHEN event_id % 33 <> 0 THEN event_type END AS kind", "CASE WHEN event_id % 8 = 0 THEN 'two' ELSE CAST(event_id % 9 AS STRING) END AS quantity")
    return rows.select("event_id", V.first_failure(R.attempts("user_id", "kind", "quantity", ["click", "purchase"], 6)).alias("reason"))
