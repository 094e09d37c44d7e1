"""Queries of scalar functions and audits over the given tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.rulesets import any_time
from .tables import _t, query

_SPELLED = "CASE o_orderkey % 5 WHEN 0 THEN {iso} WHEN 1 THEN {slash} WHEN 2 THEN {seconds} WHEN 3 THEN {millis} ELSE 'soon' END"


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN CASE WHEN o_orderkey % 5 = 1 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) ELSE date_trunc('second', o_orderdate) END END AS at FROM orders")
def F07_parse_any_time(spark, d):
    at = F.col("o_orderdate").cast("timestamp")
    text = F.expr(_SPELLED.format(iso="date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\")", slash="date_format(o_orderdate, 'yyyy/MM/dd')", seconds="CAST(s AS STRING)", millis="CAST(s * 1000 AS STRING)"))
    return _t(spark, d, "orders").withColumn("s", F.unix_timestamp(at)).select("o_orderkey", any_time(text).cast("timestamp_ntz").alias("at"))


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(w, '[0-9]+') THEN 'number' WHEN regexp_full_match(w, '[A-Za-z]+') THEN 'word' WHEN regexp_full_match(w, '[^A-Za-z0-9]+') THEN 'symbol' ELSE 'mixed' END AS kind
 FROM (SELECT unnest(string_split(p_name || ' ' || p_brand || ' ' || CAST(p_size AS VARCHAR), ' ')) AS w FROM part) WHERE w <> '') GROUP BY 1""")
def F08_kind_of(spark, d):
    w = F.col("w")
    words = _t(spark, d, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_brand", F.col("p_size").cast("string")), " ")).alias("w")).filter("w <> ''")
    kind = F.when(w.rlike("^[0-9]+$"), "number").when(w.rlike("^[A-Za-z]+$"), "word").when(w.rlike("^[^A-Za-z0-9]+$"), "symbol").otherwise("mixed")
    return words.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_PRF = "SELECT lang, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn FROM (SELECT lang, n_chars > 2000 AS p, source LIKE '%a%' AS t FROM documents) GROUP BY 1"


@query(f"SELECT lang, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM ({_PRF})")
def F12_prf(spark, d):
    p, t = F.col("n_chars") > 2000, F.col("source").like("%a%")
    sums = _t(spark, d, "documents").groupBy("lang").agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    part = lambda a, b: F.round(F.try_divide(a, b), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select("lang", "tp", "fp", "fn", part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"), part(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query("SELECT o_orderkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS valid_from, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH AS DATE) AS valid_to, CAST(date_trunc('quarter', o_orderdate) - INTERVAL 3 MONTH AS DATE) AS reference_from, CAST(date_trunc('quarter', o_orderdate) AS DATE) - 7 AS link_from FROM orders")
def F16_quarter_period(spark, d):
    start = F.trunc(F.to_date("o_orderdate"), "quarter")
    return _t(spark, d, "orders").select("o_orderkey", start.alias("valid_from"), F.add_months(start, 3).alias("valid_to"), F.add_months(start, -3).alias("reference_from"), F.date_sub(start, 7).alias("link_from"))


_LEAK = "s AS (SELECT doc_id % 5 = 0 AS test, source, coalesce(text, '') AS text FROM documents)"


@query(f"""WITH {_LEAK} SELECT (SELECT count(*) FROM (SELECT source FROM s WHERE test INTERSECT SELECT source FROM s WHERE NOT test)) AS shared_groups, (SELECT count(*) FROM (SELECT text FROM s WHERE test INTERSECT SELECT text FROM s WHERE NOT test)) AS shared_texts,
 (SELECT count(*) - count(DISTINCT text) FROM s WHERE NOT test) AS pool_duplicates""")
def M31_leakage_audit(spark, d):
    """Texts are compared by digest, aggregated before the shuffle."""
    test = F.col("doc_id") % 5 == 0
    rows = _t(spark, d, "documents").select(test.alias("test"), "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    both = lambda k: F.count_if(F.col("a") & F.col("b")).alias(k)
    sides = [F.max(F.col("test")).alias("a"), F.max(~F.col("test")).alias("b")]
    groups = rows.groupBy("source").agg(*sides).agg(both("shared_groups"))
    texts = rows.groupBy("digest").agg(*sides, F.count_if(~F.col("test")).alias("n")).agg(both("shared_texts"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("pool_duplicates"))
    return groups.join(F.broadcast(texts), how="full", on=F.lit(True))


@query("SELECT event_type AS predicted, round(count(*) / (SELECT count(*) FROM events), 6) AS accuracy FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def M32_majority_baseline(spark, d):
    counts = _t(spark, d, "events").groupBy(F.col("event_type").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    every = counts.agg(F.sum("n")).first()[0]
    return counts.orderBy(F.desc("n"), "predicted").limit(1).select("predicted", F.round(F.try_divide("n", F.lit(every)), 6).alias("accuracy"))


_RING = [(10.0, 10.0), (40.0, 15.0), (35.0, 70.0), (20.0, 40.0), (5.0, 60.0)]


def in_polygon(x, y, ring):
    """Even-odd rule: whether a point is inside, an expression over the ring's edges behind a test of its box."""
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        crosses = ((y > y1) != (y > y2)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        inside = inside != crosses
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & inside


_EDGES = " + ".join(f"CASE WHEN (y > {a[1]}) <> (y > {b[1]}) AND x < ({b[0]} - {a[0]}) * (y - {a[1]}) / ({b[1]} - {a[1]}) + {a[0]} THEN 1 ELSE 0 END" for a, b in zip(_RING, _RING[1:] + _RING[:1], strict=True))


@query(f"SELECT event_id, ({_EDGES}) % 2 = 1 AS inside FROM (SELECT event_id, (event_id * 37 % 500) / 10.0 AS x, (event_id * 53 % 800) / 10.0 AS y FROM events)")
def P03_in_polygon(spark, d):
    points = _t(spark, d, "events").selectExpr("event_id", "(event_id * 37 % 500) / 10 AS x", "(event_id * 53 % 800) / 10 AS y")
    return points.select("event_id", in_polygon(F.col("x"), F.col("y"), _RING).alias("inside"))


@query("SELECT user_id, event_type FROM (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-15') EXCEPT SELECT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-15'")
def U05_stale_keys(spark, d):
    events, half = _t(spark, d, "events"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    keys = ["user_id", "event_type"]
    return events.filter(F.col("ts") < half).select(keys).distinct().join(events.filter(F.col("ts") >= half).select(keys), keys, "left_anti")


@query("SELECT o_orderkey, greatest(0.0, least(o_totalprice / 500000, 1.0)) AS p, list_filter(['price', 'old', 'open'], lambda k: (k = 'price' AND o_totalprice > 250000) OR (k = 'old' AND o_orderdate < TIMESTAMP '1996-01-01') OR (k = 'open' AND o_orderstatus = 'O'))[1] AS first_reason FROM orders ORDER BY 2 DESC, 1 LIMIT 100")
def T05_labelling_queue(spark, d):
    p = F.greatest(F.lit(0.0), F.least(F.col("o_totalprice") / 500000, F.lit(1.0)))
    reasons = F.when(F.col("o_totalprice") > 250000, "price").when(F.col("o_orderdate") < F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"), "old").when(F.col("o_orderstatus") == "O", "open")
    return _t(spark, d, "orders").select("o_orderkey", p.alias("p"), reasons.alias("first_reason")).orderBy(F.desc("p"), "o_orderkey").limit(100)
