"""Queries over the given tables, one for each operator, beside the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import measures as M
from ..operators import series as S
from ..operators import validation as V
from ..sources.files import replace_partition, scan_partitions
from ..sources.scratch import scratch
from ..streaming.events import dedupe, drained, source

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
CUTS = [1000.0, 10000.0, 25000.0, 50000.0, 75000.0]


def query(sql: str | None):
    """Registers a query beside its SQL; None where SQL can't express it and a test holds it against a plain version."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rules() -> V.Rules:
    return [("quantity_out_of_range", ~F.col("l_quantity").between(1, 45)), ("discount_too_high", F.col("l_discount") > 0.09), ("returned", F.col("l_returnflag") == "R")]


_REASON = "CASE WHEN NOT (l_quantity BETWEEN 1 AND 45) THEN 'quantity_out_of_range' WHEN l_discount > 0.09 THEN 'discount_too_high' WHEN l_returnflag = 'R' THEN 'returned' END"


@query(f"SELECT l_orderkey, l_linenumber, {_REASON} AS reason FROM lineitem")
def V01_first_failure(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.first_failure(_rules()).alias("reason"))


@query(f"SELECT l_orderkey, l_linenumber, {_REASON} AS reason FROM lineitem WHERE {_REASON} IS NOT NULL")
def V02_split_valid(spark, d):
    return V.split_valid(_t(spark, d, "lineitem"), _rules())[1].select("l_orderkey", "l_linenumber", "reason")


@query("SELECT text, lang, count(*) - 1 AS copies FROM documents GROUP BY ALL HAVING count(*) > 1")
def V03_exact_duplicates(spark, d):
    return V.exact_duplicates(_t(spark, d, "documents"), ["text", "lang"])


@query("SELECT count(*) FILTER (NOT (l_quantity BETWEEN 1 AND 45)) AS quantity_out_of_range, count(*) FILTER (l_discount > 0.09) AS discount_too_high, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem")
def V05_warn_counts(spark, d):
    return V.warn_counts(_t(spark, d, "lineitem"), _rules())


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def V07_dangling_reference(spark, d):
    return V.dangling(_t(spark, d, "orders"), "o_custkey", _t(spark, d, "customer").filter("c_acctbal > 0"), "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def V14_latest_fetch_wins(spark, d):
    return V.latest_wins(_t(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT text, count(*) AS copies, count(DISTINCT coalesce(lang, '?')) > 1 AS conflict FROM documents GROUP BY text")
def V17_resolve_copies(spark, d):
    return V.resolve_copies(_t(spark, d, "documents").select("text", "lang"), ["text"])


@query("SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def W01_dedupe_first(spark, d):
    return V.latest_wins(_t(spark, d, "events"), ["user_id"], F.col("ts"), F.col("event_id")).select("event_id", "user_id", "ts")


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
 n AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS island FROM d),
 r AS (SELECT user_id, count(*) AS length, min(day) AS first_day FROM n GROUP BY user_id, island)
 SELECT user_id, length, first_day FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, first_day) = 1""")
def W02_streaks(spark, d):
    return S.streaks(_t(spark, d, "events").select("user_id", F.to_date("ts").alias("day")), "user_id", "day")


@query("""WITH g AS (SELECT user_id, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_from, ts AS gap_to FROM events)
 SELECT *, epoch_us(gap_to) - epoch_us(gap_from) AS gap_us FROM g WHERE epoch_us(gap_to) - epoch_us(gap_from) >= 86400000000""")
def W03_gaps(spark, d):
    return S.gaps(_t(spark, d, "events"), "user_id", "ts", 86_400, "event_id")


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
 SELECT *, CASE WHEN count(n) OVER w >= 5 THEN median(n) OVER w END AS trailing_median FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)""")
def W09_trailing_median(spark, d):
    daily = _t(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return S.trailing_median(daily, [], "day", "n", 14, 5)


@query("WITH v AS (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_quantity, n, CAST(sum(n) OVER (ORDER BY l_quantity DESC) AS BIGINT) AS at_or_above FROM v")
def W13_exact_standing(spark, d):
    return S.standing(_t(spark, d, "lineitem").select("l_quantity", F.lit(1).alias("n")), "l_quantity", "n")


@query("SELECT o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def W26_share_of_total(spark, d):
    counts = _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("o_orderstatus", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, max_by(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def X02_latest_state(spark, d):
    return S.latest_state(_t(spark, d, "events"), "user_id", "ts", "event_id", "event_type").select("user_id", "event_id", "ts", "event_type")


@query("""SELECT user_id, arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS last_purchase,
 arg_max(event_id, (ts, event_id)) FILTER (event_type = 'error') AS last_error FROM events GROUP BY user_id""")
def X03_merge_static(spark, d):
    kind = F.col("event_type")
    return S.merge_static(_t(spark, d, "events"), "user_id", "ts", "event_id", last_purchase=F.when(kind == "purchase", F.col("value")), last_error=F.when(kind == "error", F.col("event_id")))


@query("""SELECT event_id, user_id, ts < max(ts) OVER (PARTITION BY event_type ORDER BY value, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - INTERVAL 3600 SECOND AS late FROM events""")
def X05_late_flag(spark, d):
    return S.late(_t(spark, d, "events"), "event_type", ["value", "event_id"], "ts", 3600).select("event_id", "user_id", "late")


@query("SELECT date_trunc('second', ts) AS second, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1, 2")
def X07_second_counters(spark, d):
    return S.second_counters(_t(spark, d, "events"), "ts", "event_id", "event_type").withColumn("second", F.col("second").cast("timestamp_ntz"))


@query("""SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1, 2""")
def A01_user_days(spark, d):
    kind = F.col("event_type")
    return _t(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(kind == "view").alias("views"), F.count_if(kind == "purchase").alias("purchases"))


@query("SELECT user_id, event_type AS favourite, count(*) AS n FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1")
def A02_favourites(spark, d):
    return M.favourites(_t(spark, d, "events"), "user_id", "event_type")


@query("SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus) AS level, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def A13_rollup_series(spark, d):
    return M.rollup_series(_t(spark, d, "lineitem"), "l_returnflag", "l_linestatus", F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS \"A\", CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS \"N\", CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS \"R\" FROM lineitem GROUP BY 1")
def A16_pivot_amounts(spark, d):
    facts = _t(spark, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("long"))
    return M.pivot_amounts(facts, "l_suppkey", "l_returnflag", "l_quantity", ["A", "N", "R"])


@query("SELECT user_id, CAST(coalesce(sum(CASE WHEN ts <= TIMESTAMP '2024-01-10 00:00:00' THEN CASE WHEN event_type = 'error' THEN -1 ELSE 1 END END), 0) AS BIGINT) AS position, count(*) FILTER (ts <= TIMESTAMP '2024-01-10 00:00:00') AS n_events FROM events GROUP BY 1")
def A18_position_as_of(spark, d):
    deltas = _t(spark, d, "events").withColumn("delta", F.when(F.col("event_type") == "error", F.lit(-1)).otherwise(F.lit(1)))
    return S.position_as_of(deltas, "user_id", "ts", "delta", "2024-01-10 00:00:00")


@query("""SELECT 'o_custkey' AS column_name, count(*) AS n_rows, count(*) - count(o_custkey) AS n_null, count(DISTINCT o_custkey) AS n_distinct, CAST(min(o_custkey) AS VARCHAR) AS least, CAST(max(o_custkey) AS VARCHAR) AS greatest FROM orders
 UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders""")
def A25_column_profile(spark, d):
    return M.column_profile(_t(spark, d, "orders"), ["o_custkey", "o_orderstatus"])


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def J02_with_dimension(spark, d):
    # nation is a fixed list of countries
    dim = _t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return _t(spark, d, "customer").join(F.broadcast(dim), "c_nationkey", "left").select("c_custkey", "n_name")


@query("""SELECT n.n_nationkey AS c_nationkey, s.c_mktsegment, count(c.c_custkey) AS n FROM nation n CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s
 LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_mktsegment = s.c_mktsegment GROUP BY 1, 2""")
def J03_expected_grid(spark, d):
    customers = _t(spark, d, "customer")
    left = _t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return M.expected_grid(left, customers.select("c_mktsegment").distinct(), customers, F.count(F.lit(1)))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def J04_semi(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def J05_anti(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT cut, count(*) AS at_or_above FROM lineitem, (VALUES (1000.0), (10000.0), (25000.0), (50000.0), (75000.0)) c(cut) WHERE l_extendedprice >= cut GROUP BY 1".replace("SELECT cut,", "SELECT CAST(cut AS DOUBLE) AS cut,"))
def J07_range_recount(spark, d):
    return M.recount(_t(spark, d, "lineitem"), "l_extendedprice", CUTS)


@query("WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) SELECT a.day, a.n, b.n AS before FROM d a JOIN d b ON a.day = b.day + 7")
def J08_shift_join(spark, d):
    daily = _t(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return S.shift_join(daily, [], "day", "n", 7)


@query("""SELECT e.user_id, e.ts, e.event_id, (SELECT arg_max(p.value, (p.ts, p.value)) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts <= e.ts) AS value
 FROM events e WHERE e.event_type = 'error'""")
def J10_asof_rate(spark, d):
    events = _t(spark, d, "events")
    return M.as_of(events.filter("event_type = 'error'"), "user_id", "ts", "event_id", events.filter("event_type = 'purchase'"), "value")


@query("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_extendedprice >= 75000 THEN 75000 WHEN l_extendedprice >= 50000 THEN 50000 WHEN l_extendedprice >= 25000 THEN 25000 WHEN l_extendedprice >= 10000 THEN 10000 WHEN l_extendedprice >= 1000 THEN 1000 END AS DOUBLE) AS cut FROM lineitem")
def J14_place_on_ladder(spark, d):
    return M.place_on_ladder(_t(spark, d, "lineitem"), "l_extendedprice", CUTS).select("l_orderkey", "l_linenumber", "cut")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
 s AS (SELECT query_id, vec_id AS neighbour_id, round(list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(e::DOUBLE[], e::DOUBLE[])), 6) AS cosine FROM embeddings, q WHERE vec_id <> query_id)
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, neighbour_id) AS place FROM s QUALIFY place <= 10""")
def J16_knn_cosine(spark, d):
    vectors = _t(spark, d, "embeddings").select("vec_id", "embedding")
    return M.knn(vectors, vectors.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10)


@query("SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 5")
def T09_n_per_group(spark, d):
    return M.n_per_group(_t(spark, d, "orders"), "o_orderpriority", 5, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderpriority", "o_orderkey", "o_totalprice", "place")


@query("SELECT event_id, ts, value FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id DESC LIMIT 50")
def T01_ranked_feed(spark, d):
    return _t(spark, d, "events").filter("event_type = 'purchase'").orderBy(F.desc("value"), F.desc("event_id")).limit(50).select("event_id", "ts", "value")


@query("SELECT c_mktsegment, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS code FROM customer GROUP BY 1")
def M23_category_codes(spark, d):
    return M.category_codes(_t(spark, d, "customer"), "c_mktsegment")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def S03_read_json_lines(spark, d):
    return _t(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_id, user_id, event_type FROM events")
def X01_dedupe_stream(spark, d):
    """Every event is delivered twice; the stream keeps one."""
    twice = source(spark, f"{d}/events.parquet").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return drained(dedupe(twice, ["event_id"], "ts", "1 hour").select("event_id", "user_id", "event_type"), scratch(spark))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND l_returnflag = 'N'")
def S06_scan_partitions(spark, d):
    """lineitem laid out by month of shipment, then a range of days read back."""
    path = scratch(spark)
    replace_partition(_t(spark, d, "lineitem").withColumn("dt", F.to_date("l_shipdate")).withColumn("month", F.date_format("dt", "yyyy-MM")), path, "month")
    return scan_partitions(spark, path, "dt", "1995-01-01", "1996-12-31", ["l_orderkey", "l_linenumber", "l_quantity"], F.col("month").between("1995-01", "1996-12") & (F.col("l_returnflag") == "N"))


@query("SELECT user_id, day, n, views FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'view') AS views FROM events GROUP BY 1, 2) WHERE n >= 3 AND views = 0")
def P07_exclude_by_volume(spark, d):
    days = _t(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "view").alias("views"))
    return days.filter("n >= 3 and views = 0")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS BIGINT) AS lifetime_cents FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def A17_customer_value(spark, d):
    """Orders are summed by customer before the join."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    sums = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n_orders"), F.min(F.to_date("o_orderdate")).alias("first_day"), F.max(F.to_date("o_orderdate")).alias("last_day"), F.sum(cents).alias("lifetime_cents"))
    return _t(spark, d, "customer").select("c_custkey").join(sums, "c_custkey", "left").fillna(0, ["n_orders", "lifetime_cents"])


_SIDES = "a AS (SELECT o_orderkey, o_custkey, round(o_totalprice, 1) AS price FROM orders WHERE o_totalprice > 100000), b AS (SELECT o_orderkey, o_custkey, round(o_totalprice, 1) AS price FROM orders WHERE o_orderstatus = 'F')"


@query(f"WITH {_SIDES} SELECT 'first' AS only_in, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'second', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def U02_same_multiset(spark, d):
    """Rows that one side has more often than the other, both ways, prices rounded; none if the tables are the same."""
    orders = _t(spark, d, "orders")
    a, b = (orders.filter(f).select("o_orderkey", "o_custkey", F.round("o_totalprice", 1).alias("price")) for f in ("o_totalprice > 100000", "o_orderstatus = 'F'"))
    one, two = (x.exceptAll(y).select(F.lit(n).alias("only_in"), "*") for n, x, y in (("first", a, b), ("second", b, a)))
    return one.unionByName(two)


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(NULL AS VARCHAR) AS o_orderpriority FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_orderstatus, NULL, o_orderpriority FROM orders WHERE o_orderstatus = 'O'")
def U01_union_by_name(spark, d):
    orders = _t(spark, d, "orders")
    one = orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderstatus", "o_totalprice")
    two = orders.filter("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return one.unionByName(two, allowMissingColumns=True)


@query("SELECT event_id, round(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(user_id % 90.0) - radians(value % 90.0)) / 2), 2) + cos(radians(value % 90.0)) * cos(radians(user_id % 90.0)) * pow(sin((radians(event_id % 180.0) - radians(value % 180.0)) / 2), 2)))), 0) AS metres FROM events")
def F01_haversine(spark, d):
    lat1, lon1, lat2, lon2 = F.col("value") % 90.0, F.col("value") % 180.0, F.col("user_id") % 90.0, F.col("event_id") % 180.0
    return _t(spark, d, "events").select("event_id", F.round(X.haversine_m(lat1, lon1, lat2, lon2), 0).alias("metres"))


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders")
def F06_cents(spark, d):
    """Prices as money text, read back as cents."""
    text = X.format_cents(F.round(F.col("o_totalprice") * 100).cast("long"))
    return _t(spark, d, "orders").select("o_orderkey", X.parse_cents(text).alias("cents"))


@query("""WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS k FROM events GROUP BY 1)
 SELECT user_id, round((k/n + 3.8416/(2*n) - 1.96*sqrt((k/n)*(1-k/n)/n + 3.8416/(4.0*n*n))) / (1 + 3.8416/n), 6) AS low, round((k/n + 3.8416/(2*n) + 1.96*sqrt((k/n)*(1-k/n)/n + 3.8416/(4.0*n*n))) / (1 + 3.8416/n), 6) AS high FROM g""")
def F11_wilson(spark, d):
    counts = _t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("k"))
    low, high = X.wilson(F.col("k"), F.col("n"))
    return counts.select("user_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def F05_slug(spark, d):
    return _t(spark, d, "customer").select("c_custkey", X.slug(F.col("c_name")).alias("slug"))
