"""Queries of views, marts, gates and summaries over the given tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators import rulesets
from ..operators.ranks import numbered
from ..operators.series import latest_state
from ..sources.scratch import scratch
from .tables import _t, query


def _rounded(df, digits: int, *names: str):
    return df.select(*(F.round(x, digits).alias(x) if x in names else x for x in df.columns))


_STATIC = "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || c_name ELSE c_name END AS c_name, c_nationkey AS bow, CAST(c_custkey % 13 AS INT) AS stern FROM customer"


@query(f"SELECT c_custkey, nullif(trim(c_name), '') AS c_name, bow, stern, CASE WHEN bow + stern BETWEEN 1 AND 30 THEN bow + stern END AS length FROM ({_STATIC})")
def V10_clean_static(spark, d):
    rows = _t(spark, d, "customer").selectExpr("c_custkey", "CASE c_custkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN ' ' || c_name ELSE c_name END AS c_name", "c_nationkey AS bow", "CAST(c_custkey % 13 AS INT) AS stern")
    return R.clean_static(rows, ["c_name"], {"length": ("bow", "stern", 1, 30)})


@query("""WITH r AS (SELECT event_id, user_id * 100 + event_id % 40 AS id, event_type FROM events) SELECT event_id, id,
 CASE WHEN row_number() OVER w = 1 THEN 'created' WHEN event_type = first_value(event_type) OVER w THEN 'duplicate' ELSE 'conflict' END AS verdict FROM r WINDOW w AS (PARTITION BY id ORDER BY event_id)""")
def V19_delivery_conflicts(spark, d):
    rows = _t(spark, d, "events").selectExpr("event_id", "user_id * 100 + event_id % 40 AS id", "event_type")
    return rulesets.delivery_conflicts(rows, "id", "event_type", "event_id").select("event_id", "id", "verdict")


_MART = "SELECT user_id, count(*) + CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS total, count(*) FILTER (hour(ts) < 12) AS morning, count(*) FILTER (hour(ts) >= 12) AS evening, count(DISTINCT CAST(ts AS DATE)) AS days, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + CASE WHEN user_id % 11 = 0 THEN -30 ELSE 1 END AS span FROM events GROUP BY user_id"


@query(f"WITH m AS ({_MART}) SELECT user_id, 'hours_make_total' AS rule FROM m WHERE morning + evening <> total UNION ALL SELECT user_id, 'days_within_span' FROM m WHERE days > span")
def V25_consistency_rows(spark, d):
    day = F.to_date("ts")
    mart = _t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.hour("ts") < 12).alias("morning"), F.count_if(F.hour("ts") >= 12).alias("evening"), F.countDistinct(day).alias("days"), F.datediff(F.max(day), F.min(day)).alias("_span"))
    mart = mart.selectExpr("*", "_n + CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS total", "_span + CASE WHEN user_id % 11 = 0 THEN -30 ELSE 1 END AS span")
    return R.consistency_rows(mart, "user_id", {"hours_make_total": F.col("morning") + F.col("evening") == F.col("total"), "days_within_span": F.col("days") <= F.col("span")})


_PLACE = "event_id * 104729 % 18000 / 100.0 - 90 AS lat, event_id * 7919 % 36000 / 100.0 - 180 AS lon"
_LATEST = f"WITH p AS (SELECT user_id, event_id, ts, {_PLACE} FROM events), l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"
_VIEW = "v AS (SELECT l.*, (epoch_us((SELECT max(ts) FROM l)) - epoch_us(ts)) / 1000000 AS age FROM l WHERE lat BETWEEN -60 AND 60 AND lon BETWEEN -150 AND 170 QUALIFY age <= 2000000 AND row_number() OVER (ORDER BY ts DESC, user_id) <= 20)"


def _positions(spark, d):
    return _t(spark, d, "events").selectExpr("user_id", "event_id", "ts", "event_id * 104729 % 18000 / 100.0D - 90 AS lat", "event_id * 7919 % 36000 / 100.0D - 180 AS lon")


def _view(spark, d):
    newest = latest_state(_positions(spark, d), "user_id", "ts", "event_id", "lat", "lon")
    return R.live_view(newest, "lat", "lon", "ts", (-60, -150, 60, 170), 2_000_000, 20, "user_id")


@query(f"{_LATEST}, {_VIEW} SELECT user_id, event_id, ts, round(lat, 6) AS lat, round(lon, 6) AS lon, round(age, 3) AS age_seconds FROM v")
def P02_live_view(spark, d):
    return _rounded(_rounded(_view(spark, d).select("user_id", "event_id", "ts", "lat", "lon", "age_seconds"), 6, "lat", "lon"), 3, "age_seconds")


@query(f"{_LATEST}, {_VIEW} SELECT p.user_id, p.event_id, p.ts FROM v JOIN p USING (user_id) WHERE p.ts BETWEEN v.ts - INTERVAL 3000 MINUTE AND v.ts")
def J19_trails(spark, d):
    return R.trails(_view(spark, d), _positions(spark, d), "user_id", "ts", 3000).select("user_id", "event_id", "ts")


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('fr', 'en') AND source IN ('src0', 'src1')")
def P04_filter_categories(spark, d):
    wanted = {"lang": ["fr", "en"], "source": ["src0", "src1"]}
    return R.filter_categories(_t(spark, d, "documents").select("doc_id", "lang", "source"), wanted, wanted)


_UNITS = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderpriority FROM orders"
_LEVELS = ["1-URGENT", "2-HIGH", "5-LOW"]


@query(f"""WITH u AS ({_UNITS}) SELECT o_orderkey, coalesce(price, (SELECT median(price) FROM u WHERE o_orderkey % 3 <> 0)) AS price, o_orderpriority,
 {", ".join(f'''CAST(o_orderpriority = '{x}' AS INT) AS "o_orderpriority={x}"''' for x in _LEVELS)} FROM u""")
def P09_featurize(spark, d):
    units = _t(spark, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price", "o_orderpriority")
    return R.featurize(units, R.medians(units.filter("o_orderkey % 3 <> 0"), ["price"]), ["price"], {"o_orderpriority": _LEVELS})


@query("""SELECT event_id, CAST(CASE WHEN user_id % 9 = 0 THEN json_object('event_type', event_type, 'event_id', event_id) ELSE json_object('user_id', user_id, 'event_type', event_type, 'event_id', event_id) END AS VARCHAR) AS detail FROM events""")
def P10_attach_detail(spark, d):
    rows = _t(spark, d, "events").selectExpr("event_id", "CASE WHEN user_id % 9 <> 0 THEN user_id END AS user_id", "event_type")
    return R.attach_detail(rows, ["user_id", "event_type", "event_id"]).select("event_id", "detail")


@query("""SELECT user_id, n, favourite, months FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) JOIN (SELECT user_id, event_type AS favourite FROM (SELECT user_id, event_type, count(*) AS k FROM events WHERE value > 20 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC, event_type) = 1) USING (user_id)
 JOIN (SELECT user_id, count(DISTINCT day(ts)) AS months FROM events WHERE event_type = 'purchase' GROUP BY 1) USING (user_id)""")
def J01_assemble_mart(spark, d):
    events = _t(spark, d, "events")
    counts = events.filter("value > 20").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("k"))
    favourites = counts.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("k"), "event_type")).alias("favourite"))
    days = events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.countDistinct(F.dayofmonth("ts")).alias("months"))
    return R.assemble_mart("user_id", events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), favourites, days)


@query("""SELECT c_custkey, c_name, any_value(x.o_orderstatus) AS o_orderstatus, any_value(x.o_totalprice) AS o_totalprice, any_value(x.o_orderdate) AS last_seen, count(o.o_orderkey) AS n_facts FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_custkey % 4 <> 0) o ON o.o_custkey = c_custkey
 LEFT JOIN (SELECT * FROM orders WHERE o_custkey % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) x ON x.o_custkey = c_custkey GROUP BY 1, 2""")
def J22_entity_card(spark, d):
    facts = _t(spark, d, "orders").filter("o_custkey % 4 <> 0").withColumnRenamed("o_custkey", "c_custkey")
    return R.entity_card(_t(spark, d, "customer").select("c_custkey", "c_name"), facts, "c_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", "o_totalprice")


_POINTS = "p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label FROM embeddings)"
_NEAR = "a AS (SELECT q.vec_id AS query_id, p.vec_id AS neighbour_id, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS squared FROM p, p q WHERE q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY squared, neighbour_id) AS place FROM a QUALIFY place <= 10)"


def _near(spark, d):
    points = _t(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return R.knn_2d(points, points.filter("vec_id % 100 = 0"), "vec_id", "x", "y", 10)


@query(f"WITH {_POINTS}, {_NEAR} SELECT query_id, neighbour_id, round(squared, 9) AS squared, CAST(place AS INT) AS place FROM n")
def J17_knn_2d(spark, d):
    return _rounded(_near(spark, d), 9, "squared")


@query(f"""WITH {_POINTS}, {_NEAR}, q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
 s AS (SELECT query_id, vec_id AS neighbour_id, round(list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(e::DOUBLE[], e::DOUBLE[])), 6) AS cosine FROM embeddings, q WHERE vec_id <> query_id),
 h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, neighbour_id) AS place FROM s QUALIFY place <= 10)
 SELECT query_id, (SELECT count(*) FROM h JOIN n USING (query_id, neighbour_id) WHERE h.query_id = z.query_id) / 10 AS recall, (SELECT avg(CAST(p.label = o.label AS INT)) FROM n JOIN p ON p.vec_id = n.neighbour_id JOIN p o ON o.vec_id = n.query_id WHERE n.query_id = z.query_id) AS purity FROM (SELECT DISTINCT query_id FROM n) z""")
def U04_neighbour_recall(spark, d):
    from ..operators.measures import knn

    vectors = _t(spark, d, "embeddings")
    high = knn(vectors.select("vec_id", "embedding"), vectors.filter("vec_id % 100 = 0").select("vec_id", "embedding"), "vec_id", "embedding", 10)
    return _rounded(R.neighbour_recall(high, _near(spark, d), vectors, "vec_id", "label"), 6, "recall", "purity")


_METRICS = {"view": ["visits"], "click": ["visits", "attempts"], "purchase": ["attempts", "sold"]}


@query("""SELECT date_trunc('second', ts) AS second, metric, count(*) AS n FROM (SELECT ts, unnest(CASE event_type WHEN 'view' THEN ['visits'] WHEN 'click' THEN ['visits', 'attempts'] WHEN 'purchase' THEN ['attempts', 'sold'] END) AS metric FROM events) GROUP BY 1, 2""")
def A20_sale_stats(spark, d):
    stats = R.sale_stats(_t(spark, d, "events"), "ts", "event_type", _METRICS)
    return stats.withColumn("second", F.col("second").cast("timestamp_ntz"))


_LINES = "SELECT event_type, CASE user_id % 10 WHEN 0 THEN '{\"k\": ' WHEN 1 THEN '{\"k\": 1, \"j\": 2}' ELSE props END AS line FROM events"


@query(f"""WITH l AS ({_LINES}), k AS (SELECT event_type, line, json_valid(line) AS ok FROM l), n AS (SELECT event_type, unnest(json_keys(CASE WHEN ok THEN line ELSE '{{}}' END)) AS name FROM k), w AS (SELECT event_type, count(*) AS lines, count(*) FILTER (NOT ok) AS invalid FROM k GROUP BY 1)
 SELECT w.event_type AS source, lines, invalid, name, count(*) AS with_name, any_value(lines - invalid) - count(*) AS missing FROM w JOIN n USING (event_type) GROUP BY w.event_type, lines, invalid, name""")
def A26_feed_profile(spark, d):
    return R.feed_profile(_t(spark, d, "events").selectExpr("event_type", "CASE user_id % 10 WHEN 0 THEN '{\"k\": ' WHEN 1 THEN '{\"k\": 1, \"j\": 2}' ELSE props END AS line"), "event_type", "line")


@query("""WITH h AS (SELECT o_custkey, o_totalprice, ln(o_totalprice) - ln(lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS change FROM orders WHERE o_totalprice > 0)
 SELECT o_custkey, count(*) AS n, round((max(o_totalprice) - min(o_totalprice)) / median(o_totalprice), 6) AS spread, round(avg(o_totalprice) / median(o_totalprice), 6) AS mean_over_median, round(stddev_samp(change), 6) AS volatility, count(*) FILTER (abs(change) > 1) AS spikes FROM h GROUP BY 1""")
def A27_market_profile(spark, d):
    return _rounded(R.market_profile(_t(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice", 1.0), 6, "spread", "mean_over_median", "volatility")


@query("""WITH s AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS story FROM events WHERE value > 90 GROUP BY 1), w AS (SELECT count(*) AS stories, sum(n) AS total, max(n) AS most FROM (SELECT story, count(*) AS n FROM s GROUP BY 1))
 SELECT card, count(*) AS users, round(count(*) / any_value(total), 6) AS share, any_value(stories) AS stories, round(any_value(most / total), 6) AS common_share FROM (SELECT unnest(story) AS card FROM s), w GROUP BY 1""")
def A31_story_distribution(spark, d):
    stories = _t(spark, d, "events").filter("value > 90").groupBy("user_id").agg(F.collect_set("event_type").alias("cards"))
    return _rounded(R.story_distribution(stories, "cards"), 6, "share", "common_share")


@query("""WITH r AS (SELECT event_type, CASE WHEN value < 5 THEN 'too_small' WHEN user_id % 9 = 0 THEN 'automation' END AS reason, hour(ts) = 23 AS late FROM events), g AS (SELECT event_type, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY ALL)
 SELECT event_type, count(*) FILTER (reason IS NULL) AS valid, count(reason) AS quarantined, count(*) FILTER (late) AS late, coalesce((SELECT string_agg(g.reason || '=' || g.n, ',' ORDER BY g.reason || '=' || g.n) FROM g WHERE g.event_type = r.event_type), '') AS reasons FROM r GROUP BY 1""")
def A33_quality_counts(spark, d):
    rows = _t(spark, d, "events").selectExpr("event_type", "CASE WHEN value < 5 THEN 'too_small' WHEN user_id % 9 = 0 THEN 'automation' END AS reason", "hour(ts) = 23 AS late")
    return R.quality_counts(rows, "event_type", "reason", "late")


@query("""WITH p AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_partkey % 50 AS item, median(l_extendedprice) AS price FROM lineitem WHERE (l_partkey + month(l_shipdate)) % 50 < 47 GROUP BY 1, 2),
 w AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, median(o_totalprice) AS wage FROM orders GROUP BY 1), b AS (SELECT month, CASE WHEN count(DISTINCT item) = 3 THEN sum(price * CASE item WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 0.5 END) END AS cost FROM p WHERE item IN (1, 4, 9) GROUP BY 1)
 SELECT month, wage, round(cost, 4) AS basket_cost, round(cost / wage, 6) AS hours, round(wage * (SELECT arg_min(cost, month) FROM b JOIN w USING (month) WHERE cost IS NOT NULL) / cost, 4) AS real_wage FROM w LEFT JOIN b USING (month)""")
def A35_purchasing_power(spark, d):
    sold = _t(spark, d, "lineitem").filter((F.col("l_partkey") + F.month("l_shipdate")) % 50 < 47)
    prices = sold.groupBy(F.trunc("l_shipdate", "month").alias("month"), (F.col("l_partkey") % 50).alias("item")).agg(F.percentile("l_extendedprice", F.lit(0.5)).alias("price"))
    wages = _t(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.percentile("o_totalprice", F.lit(0.5)).alias("wage"))
    return _rounded(_rounded(R.purchasing_power(prices, wages, "month", "item", {1: 2.0, 4: 1.0, 9: 0.5}), 6, "hours"), 4, "basket_cost", "real_wage")


@query("SELECT user_id, count(*) AS samples, max(event_id % 4) AS most_blocked, max(value) AS longest, round(quantile_cont(value, 0.95), 6) AS p95, count(*) FILTER (event_id % 4 > 0) * 0.5::DOUBLE AS blocked_seconds FROM events GROUP BY 1")
def A36_lock_waits(spark, d):
    return _rounded(R.lock_waits(_t(spark, d, "events").withColumn("blocked", F.col("event_id") % 4), "user_id", "blocked", "value", 0.5), 6, "p95")


@query("SELECT o_orderpriority, length(CAST(floor(o_totalprice) AS BIGINT)::VARCHAR) - 1 AS magnitude, count(*) AS runs, median(1 + o_orderkey % 97) AS median, round(quantile_cont(CAST(1 + o_orderkey % 97 AS DOUBLE), 0.95), 6) AS p95, round(sum(CAST(floor(o_totalprice) AS BIGINT)) / sum(1 + o_orderkey % 97), 4) AS rate FROM orders WHERE o_totalprice >= 1 GROUP BY 1, 2")
def A36_duration_by_size(spark, d):
    runs = _t(spark, d, "orders").selectExpr("o_orderpriority", "CAST(floor(o_totalprice) AS BIGINT) AS size", "1 + o_orderkey % 97 AS seconds")
    return _rounded(_rounded(R.duration_by_size(runs, "o_orderpriority", "size", "seconds"), 6, "p95"), 4, "rate")


_HALF = "SELECT user_id, avg(value) AS score, count(*) AS cost FROM events WHERE day(ts) {} GROUP BY 1"


@query(f"""WITH b AS ({_HALF.format('<= 15')}), n AS ({_HALF.format('> 15')} HAVING user_id % 10 <> 3), x AS (SELECT b.user_id, n.user_id AS there, n.score AS s, b.score AS t, n.cost / (SELECT cost FROM n WHERE user_id = 1) AS r, b.cost / (SELECT cost FROM b WHERE user_id = 1) AS q FROM b LEFT JOIN n USING (user_id))
 SELECT user_id, 'missing' AS failure FROM x WHERE there IS NULL UNION ALL SELECT user_id, 'score' FROM x WHERE s < t - 5 UNION ALL SELECT user_id, 'cost' FROM x WHERE user_id <> 1 AND r > q * 1.25 UNION ALL SELECT user_id, 'no_reference' FROM x WHERE user_id = 1 AND there IS NULL""")
def A38_regression_gate(spark, d):
    half = lambda when: _t(spark, d, "events").filter(when).groupBy("user_id").agg(F.avg("value").alias("score"), F.count(F.lit(1)).alias("cost"))
    return R.regression_gate(half("day(ts) > 15").filter("user_id % 10 <> 3"), half("day(ts) <= 15"), "user_id", "score", "cost", 1, 5.0, 0.25)


@query("""WITH k AS (SELECT l_returnflag, l_extendedprice AS a, p_retailprice * l_quantity AS b, abs(ln(l_extendedprice / (p_retailprice * l_quantity))) AS e FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_extendedprice > 0 AND p_retailprice * l_quantity > 0)
 SELECT l_returnflag, count(*) AS n, round(avg(e), 6) AS mean_error, round(quantile_cont(e, 0.95), 6) AS p95_error, round(max(e), 6) AS max_error, round(avg(CAST(e > ln(2) AS INT)), 6) AS beyond_2x, round(avg(CAST(e > ln(4) AS INT)), 6) AS beyond_4x, round(corr(ln(1 + a), ln(1 + b)), 6) AS correlation FROM k GROUP BY 1""")
def A41_accuracy_vs_truth(spark, d):
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = _t(spark, d, "lineitem").join(parts, "l_partkey").withColumn("truth", F.col("p_retailprice") * F.col("l_quantity"))
    return _rounded(R.accuracy_vs_truth(rows, "l_returnflag", "l_extendedprice", "truth"), 6, "mean_error", "p95_error", "max_error", "beyond_2x", "beyond_4x", "correlation")


@query("""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 1.01 ELSE o_totalprice * (1 + 1e-13) END AS o_totalprice, CASE WHEN o_orderkey % 75 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders)
 SELECT row_number() OVER (ORDER BY a.o_orderkey) AS place, concat_ws(',', CASE WHEN abs(a.o_totalprice - b.o_totalprice) > 1e-9 * b.o_totalprice THEN 'o_totalprice' END, CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 'o_orderstatus' END) AS columns FROM orders a JOIN b USING (o_orderkey) QUALIFY columns <> ''""")
def A46_same_result(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    other = orders.selectExpr("o_orderkey", "CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 1.01D ELSE o_totalprice * (1 + 1e-13D) END AS o_totalprice", "CASE WHEN o_orderkey % 75 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus")
    return R.same_result(orders, other, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


@query("""WITH s AS (SELECT url, CASE WHEN url IS NULL THEN 'null' WHEN regexp_matches(url, '^https?://[^/]+/?$') THEN 'root' WHEN regexp_matches(url, '/[0-9]+$') THEN 'numbered' WHEN regexp_matches(url, '^https?://[^/]+/[^/]+$') THEN 'one_level' ELSE 'other' END AS shape FROM pages)
 SELECT shape, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, min(url) AS example, CAST(min(length(url)) AS INT) AS shortest, CAST(max(length(url)) AS INT) AS longest FROM s GROUP BY 1""")
def A48_text_shapes(spark, d):
    return _rounded(R.text_shapes(_t(spark, d, "pages"), "url", [("root", "^https?://[^/]+/?$"), ("numbered", "/[0-9]+$"), ("one_level", "^https?://[^/]+/[^/]+$")]), 6, "share")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS place FROM events")
def W27_global_sequence(spark, d):
    return numbered(_t(spark, d, "events").select("event_id", "ts"), "place", F.col("ts"), F.col("event_id")).select("event_id", "place")


@query("SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem")
def T02_total_order_write(spark, d):
    path = scratch(spark)
    R.total_order_write(_t(spark, d, "lineitem").select("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"), path, "l_shipdate", "l_orderkey")
    return spark.read.parquet(path)


@query("""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum(o_orderkey) AS s FROM orders WHERE o_orderkey % 400 <> 0 GROUP BY 1), n AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum(o_orderkey) AS s FROM orders GROUP BY 1),
 c AS (SELECT coalesce(o.day, n.day) AS day FROM o FULL JOIN n ON o.day = n.day WHERE o.n IS DISTINCT FROM n.n OR o.s IS DISTINCT FROM n.s), x AS (SELECT day, CAST(day + INTERVAL 1 DAY * a AS DATE) AS t, a FROM c, range(0, 15) r(a)) SELECT t AS day, bool_or(a = 0) AS changed FROM x GROUP BY 1""")
def X10_changed_days(spark, d):
    prints = lambda rows: rows.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"))
    orders = _t(spark, d, "orders")
    return R.changed_days(prints(orders.filter("o_orderkey % 400 <> 0")), prints(orders), "day", 14)


@query("""WITH f AS (SELECT DISTINCT event_id % 211 AS file FROM events), l AS (SELECT event_id % 211 AS file, CASE WHEN value < 30 OR event_id % 211 % 17 = 0 THEN 'bad' END AS reason FROM events WHERE event_id % 211 % 50 <> 7)
 SELECT file, count(l.file) AS read, count(reason) AS quarantined, count(l.file) - count(reason) AS accepted, CASE WHEN count(l.file) = 0 THEN 'empty' WHEN count(l.file) = count(reason) THEN 'refused' WHEN count(reason) > 0 THEN 'partial' ELSE 'ok' END AS status FROM f LEFT JOIN l USING (file) GROUP BY 1""")
def S05_file_manifest(spark, d):
    lines = _t(spark, d, "events").selectExpr("event_id % 211 AS file", "CASE WHEN value < 30 OR event_id % 211 % 17 = 0 THEN 'bad' END AS reason")
    return R.file_manifest(lines.filter("file % 50 <> 7"), lines, "file", "reason")


@query("""WITH r AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'static/1' WHEN 'view' THEN 'position/1' WHEN 'click' THEN 'position/2' ELSE event_type END AS topic, CASE WHEN event_id % 13 = 0 THEN '{"k"' ELSE props END AS body FROM events)
 SELECT event_id, CASE WHEN NOT json_valid(body) THEN 'reject' WHEN topic LIKE 'static%' THEN 'static' WHEN topic LIKE 'position%' THEN 'position' ELSE 'dead' END AS route FROM r""")
def S10_route(spark, d):
    records = _t(spark, d, "events").selectExpr("event_id", "CASE event_type WHEN 'signup' THEN 'static/1' WHEN 'view' THEN 'position/1' WHEN 'click' THEN 'position/2' ELSE event_type END AS topic", "CASE WHEN event_id % 13 = 0 THEN '{\"k\"' ELSE props END AS body")
    return R.route(records, "topic", "body").select("event_id", "route")


@query("SELECT event_id, value FROM events WHERE value < 20 AND event_id % 3 <> 0")
def S14_replay_quarantine(spark, d):
    events = _t(spark, d, "events").selectExpr("event_id", "value", "CASE WHEN value < 20 THEN 'too_small' WHEN value > 90 THEN 'too_large' END AS reason").filter("reason is not null")
    return R.replay_quarantine(events, events.filter("event_id % 3 = 0"), "event_id", "reason", "too_small").select("event_id", "value")


_SPIKES = "t AS (SELECT event_id, CASE WHEN value > 80 THEN 'high' WHEN value < 10 THEN 'low' END AS kind FROM events WHERE value > 80 OR value < 10), f AS (SELECT event_id, event_type AS kind FROM events WHERE event_id % 4 <> 0)"


@query(f"""WITH {_SPIKES} SELECT kind, count(*) AS injected, count(*) FILTER (hit) AS caught, round(count(*) FILTER (hit) / count(*), 6) AS recall FROM (SELECT t.kind, EXISTS (SELECT 1 FROM f WHERE f.event_id = t.event_id AND ((t.kind = 'high' AND f.kind IN ('purchase', 'view')) OR (t.kind = 'low' AND f.kind = 'error'))) AS hit FROM t) GROUP BY 1""")
def A41_recall_by_kind(spark, d):
    events = _t(spark, d, "events")
    truth = events.selectExpr("event_id", "CASE WHEN value > 80 THEN 'high' WHEN value < 10 THEN 'low' END AS kind").filter("kind is not null")
    found = events.filter("event_id % 4 <> 0").selectExpr("event_id", "event_type AS kind")
    return _rounded(R.recall_by_kind(truth, found, ["event_id"], "kind", {"high": ["purchase", "view"], "low": ["error"]}), 6, "recall")


_BROKEN = "SELECT vec_id, CASE WHEN vec_id % 41 = 0 THEN NULL ELSE 'v' || vec_id % 450 END AS token, CASE WHEN vec_id % 20 = 1 THEN {short} WHEN vec_id % 33 = 2 THEN {zero} ELSE embedding END AS embedding FROM embeddings"


@query(f"""WITH r AS ({_BROKEN.format(short='embedding[1:63]', zero='list_transform(embedding, lambda x: 0)')}), s AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY vec_id) AS seen FROM r)
 SELECT vec_id, CASE WHEN token IS NULL THEN 'missing_token' WHEN len(embedding) <> 64 THEN 'field_count' WHEN len(list_filter(embedding, lambda x: x = 0)) = 64 THEN 'all_zero' WHEN seen > 1 THEN 'repeated_token' END AS reason FROM s""")
def V23_validate_vectors(spark, d):
    from pyspark.sql import Window

    from ..operators.validation import first_failure

    rows = _t(spark, d, "embeddings").selectExpr("vec_id", "CASE WHEN vec_id % 41 = 0 THEN NULL ELSE 'v' || vec_id % 450 END AS token", "CASE WHEN vec_id % 20 = 1 THEN slice(embedding, 1, 63) WHEN vec_id % 33 = 2 THEN transform(embedding, x -> float(0)) ELSE embedding END AS embedding")
    seen = rows.withColumn("_seen", F.row_number().over(Window.partitionBy("token").orderBy("vec_id")))
    return seen.select("vec_id", first_failure(rulesets.vectors("embedding", 64)).alias("reason"))
