"""Queries of the silence chain and of set, paging and lookup operators, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import silence as S
from ..operators import tracks as T
from .reports import _rounded
from .tables import _t, query

#: Position reports made from events: 11 by 12 tenths of a degree, now and then 8 degrees off.
_POS = """SELECT user_id AS thing, ts, 55 + user_id * 37 % 11 / 10 + event_id * 13 % 100 / 1000 + CASE WHEN event_id % 53 = 0 THEN 8 ELSE 0 END AS lat, 10 + user_id * 53 % 12 / 10 + event_id * 7 % 100 / 1000 AS lon,
 CASE event_type WHEN 'view' THEN 0.0 WHEN 'error' THEN NULL WHEN 'click' THEN 8.0 ELSE 0.5 + event_id % 10 END AS knots, CASE WHEN event_id % 31 = 0 THEN NULL ELSE event_id * 29 % 360 END AS course FROM events"""
_RULES = T.Rules(moving_s=36_000.0, moored_s=86_400.0, max_knots=20.0, cell_deg=0.5, least_reception=0.4, radius_m=25_000.0, lookback_h=240.0, spot_s=3600.0, window_s=7200.0)
_R = _RULES


def _metres(lat1, lon1, lat2, lon2):
    return f"2 * 6371000.0 * asin(sqrt(least(1.0, power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin((radians({lon2}) - radians({lon1})) / 2), 2))))"


def _reckoned(lat, lon, knots, course, seconds):
    """SQL of dead reckoning: (latitude, longitude)."""
    way, far = f"radians(CASE WHEN {seconds} >= 0 THEN {course} ELSE ({course} + 180) % 360 END)", f"({knots} * {1852 / 3600} * abs({seconds}) / 6371000.0)"
    p2 = f"asin(greatest(-1.0, least(1.0, sin(radians({lat})) * cos({far}) + cos(radians({lat})) * sin({far}) * cos({way}))))"
    over = f"degrees(radians({lon}) + atan2(sin({way}) * sin({far}) * cos(radians({lat})), cos({far}) - sin(radians({lat})) * sin({p2}))) + 180"
    moves = f"coalesce({knots}, 0) <> 0 AND {course} IS NOT NULL"
    return f"CASE WHEN {moves} THEN degrees({p2}) ELSE {lat} END", f"CASE WHEN {moves} THEN (({over}) % 360 + 360) % 360 - 180 ELSE {lon} END"


_AT = f"""e AS (SELECT DISTINCT ON (thing, ts) * FROM ({_POS}) ORDER BY thing, ts, lat, lon, knots NULLS FIRST, course NULLS FIRST), n AS (SELECT max(ts) AS now FROM e), s AS (SELECT now - INTERVAL {int(_R.lookback_h)} HOUR AS since, date_trunc('hour', now) AS hi FROM n)"""
_GRID = f"""g AS (SELECT CAST(floor(lon / {_R.cell_deg}) AS BIGINT) AS cx, CAST(floor(lat / {_R.cell_deg}) AS BIGINT) AS cy, count(DISTINCT date_trunc('hour', ts)) AS hours_heard, count(DISTINCT thing) AS vessels,
 (SELECT count(DISTINCT date_trunc('hour', ts)) FROM e, s WHERE ts >= hi - INTERVAL {int(_R.lookback_h)} HOUR AND ts < hi) AS hours_window FROM e, s WHERE ts >= hi - INTERVAL {int(_R.lookback_h)} HOUR AND ts < hi GROUP BY 1, 2),
 grid AS (SELECT *, hours_heard / hours_window AS reliability FROM g)"""
_OPEN = f"""o AS (SELECT thing, ts AS silent_from, (epoch_us(now) - epoch_us(ts)) / 1e6 AS seconds, lat AS lat0, lon AS lon0, knots AS knots0, course AS course0 FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY thing ORDER BY ts DESC) = 1), n, s
 WHERE ts >= since AND ts <= now - INTERVAL {int(_R.moving_s)} SECOND AND knots >= {_R.moored_knots})"""
_SILENT = f"""l AS (SELECT thing, {', '.join(f'{x} AS {x}1, lag({x}) OVER w AS {x}0' for x in ('ts', 'lat', 'lon', 'knots', 'course'))} FROM e, s WHERE ts >= since WINDOW w AS (PARTITION BY thing ORDER BY ts)),
 m AS (SELECT *, epoch_us(ts1) / 1e6 - epoch_us(ts0) / 1e6 AS seconds, {_metres('lat0', 'lon0', 'lat1', 'lon1')} AS metres FROM l WHERE ts0 IS NOT NULL), {_OPEN},
 q AS (SELECT thing, ts0 AS silent_from, ts1 AS silent_to, seconds, metres, lat0, lon0, knots0, course0, lat1, lon1, knots1, course1 FROM m WHERE seconds >= CASE WHEN coalesce(knots0, 0) >= {_R.moored_knots} OR metres > {_R.moored_m} THEN {_R.moving_s} ELSE {_R.moored_s} END
  OR (metres >= {_R.jump_m} AND metres / seconds > {_R.max_knots * 1852 / 3600}) UNION ALL BY NAME SELECT thing, silent_from, seconds, lat0, lon0, knots0, course0 FROM o)"""
_SPOT = _reckoned("lat0", "lon0", "knots0", "course0", f"least({_R.spot_s}, seconds / 2)")
_NEAR = f"""spot AS (SELECT thing, silent_from, {_SPOT[0]} AS lat, {_SPOT[1]} AS lon, epoch_us(silent_from) / 1e6 AS t0, epoch_us(silent_from) / 1e6 + least({_R.window_s}, seconds) AS t1 FROM q),
 near AS (SELECT a.thing, a.silent_from, count(DISTINCT b.thing) AS n_near FROM spot a LEFT JOIN (SELECT *, epoch_us(ts) / 1e6 AS tm FROM e) b ON b.tm > a.t0 AND b.tm <= a.t1 AND b.thing <> a.thing AND {_metres('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {_R.radius_m} GROUP BY 1, 2)"""
_TRACK = " UNION ALL ".join(f"SELECT thing, silent_from, {side} AS side, CAST(floor(({p[1]}) / {_R.cell_deg}) AS BIGINT) AS cx, CAST(floor(({p[0]}) / {_R.cell_deg}) AS BIGINT) AS cy FROM q" for side, sign in ((0, 1), (1, -1)) for s in T.TRACK_S for p in [_reckoned(f"lat{side}", f"lon{side}", f"knots{side}", f"course{side}", f"({sign * s})")])
_HEARD = f"""track AS ({_TRACK}), heard AS (SELECT thing, silent_from, min(coalesce(reliability, 0)) FILTER (side = 0) AS reception_from, min(coalesce(reliability, 0)) FILTER (side = 1) AS reception_to FROM track LEFT JOIN grid USING (cx, cy) WHERE cx IS NOT NULL GROUP BY 1, 2)"""
_JUDGED = f"""f AS (SELECT *, metres / seconds / {1852 / 3600} AS knots, coalesce(metres / seconds / {1852 / 3600} > {_R.max_knots} AND metres >= {_R.jump_m}, false) AS impossible,
  CASE WHEN seconds < CASE WHEN coalesce(knots0, 0) >= {_R.moored_knots} OR coalesce(metres, 0) > {_R.moored_m} THEN {_R.moving_s} ELSE {_R.moored_s} END THEN 'position_jump'
   WHEN reception_from >= {_R.least_reception} AND (reception_to IS NULL OR reception_to >= {_R.least_reception}) AND n_near >= 1 THEN 'dark' ELSE 'coverage_gap' END AS verdict, CAST(floor(seconds / 60 + 0.5) AS BIGINT) AS mins FROM q JOIN near USING (thing, silent_from) JOIN heard USING (thing, silent_from)),
 j AS (SELECT *, round(least(100.0, CASE verdict WHEN 'dark' THEN 45.0 + least(10.0, 10.0 * seconds / 43200) + least(10.0, 2.0 * n_near) + CASE WHEN coalesce(knots0, 0) >= 5 THEN 5.0 ELSE 0.0 END WHEN 'coverage_gap' THEN 5.0 ELSE 30.0 END
   + CASE WHEN impossible THEN 30.0 + least(10.0, 5.0 * log10(knots / {_R.max_knots})) ELSE 0.0 END), 1) AS score,
  array_to_string(list_filter(['silent for ' || CASE WHEN mins >= 60 THEN mins // 60 || ' h ' || lpad(CAST(mins % 60 AS VARCHAR), 2, '0') || ' min' ELSE mins || ' min' END || CASE WHEN silent_to IS NULL THEN ', not heard again yet' ELSE '' END,
   CASE WHEN verdict = 'dark' THEN 'reception ' || round(reception_from, 2) || ' where it vanished' || coalesce(', ' || round(reception_to, 2) || ' where it returned', '') END,
   CASE WHEN verdict = 'dark' THEN n_near || CASE WHEN n_near = 1 THEN ' other was heard nearby' ELSE ' others were heard nearby' END END, CASE WHEN verdict = 'dark' AND coalesce(knots0, 0) >= 5 THEN 'under way at ' || round(CAST(knots0 AS DOUBLE), 1) || ' kn when it vanished' END,
   CASE WHEN verdict = 'coverage_gap' AND reception_from < {_R.least_reception} THEN 'was leaving reliable coverage, reception ' || round(reception_from, 2) END, CASE WHEN verdict = 'coverage_gap' AND reception_to < {_R.least_reception} THEN 'returned from outside reliable coverage, reception ' || round(reception_to, 2) END,
   CASE WHEN verdict = 'coverage_gap' AND n_near = 0 THEN 'nobody else was heard nearby: the receiver may have been down' END,
   CASE WHEN impossible THEN 'reappeared ' || CAST(floor(metres / 1852 + 0.5) AS BIGINT) || ' nm away: needs ' || CAST(floor(knots + 0.5) AS BIGINT) || ' kn' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM f)"""
_SAID = "thing, silent_from, silent_to, round(seconds, 3) AS seconds, round(metres, 3) AS metres, round(knots, 3) AS knots, round(reception_from, 6) AS reception_from, round(reception_to, 6) AS reception_to, n_near, verdict, impossible, score, reasons"


def _positions(spark, d):
    return T.positions(spark.sql(_POS.replace("FROM events", "FROM {events}"), events=_t(spark, d, "events")), "thing", "ts", "lat", "lon", "knots", "course")


@query(f"WITH {_AT}, {_SILENT} SELECT thing, silent_from, silent_to, round(seconds, 3) AS seconds, round(metres, 3) AS metres FROM q")
def W03_silences(spark, d):
    at = _positions(spark, d)
    return _rounded(T.silences(at, T.newest(at), _R).select(*T.KEYS, "silent_to", "seconds", "metres"), 3, "seconds", "metres")


@query(f"WITH {_AT}, {_OPEN} SELECT thing, silent_from, round(seconds, 3) AS seconds FROM o")
def W04_open_gaps(spark, d):
    at = _positions(spark, d)
    return _rounded(T.open_silences(at, T.newest(at), _R).select(*T.KEYS, "seconds"), 3, "seconds")


@query(f"WITH {_AT}, {_GRID} SELECT * FROM grid")
def A05_reception_grid(spark, d):
    at = _positions(spark, d)
    return T.reception_grid(at, T.newest(at), _R)


@query(f"WITH {_AT}, {_SILENT}, {_NEAR} SELECT thing, silent_from, n_near FROM near")
def J06_neighbours(spark, d):
    at = _positions(spark, d)
    return T.neighbours(T.silences(at, T.newest(at), _R), at, _R)


@query(f"WITH {_AT}, {_GRID}, {_SILENT}, {_NEAR}, {_HEARD}, {_JUDGED} SELECT {_SAID} FROM j")
def W05_assess(spark, d):
    """The whole chain: silences, who was near, reception along the track, verdict, score and reasons."""
    at = _positions(spark, d)
    now = T.newest(at)
    return said(T.assess(at, T.reception_grid(at, now, _R), now, _R))


def said(judged):
    return _rounded(_rounded(judged, 3, "seconds", "metres", "knots"), 6, "reception_from", "reception_to")


_POINT = "SELECT event_id, value % 80 AS lat1, user_id % 170 - 85 AS lon1, user_id % 60 AS lat2, event_id % 360 - 180 AS lon2, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 30 END AS knots, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id * 7 % 360 END AS course, event_id % 7201 - 3600 AS s FROM events"
_WAY = _reckoned("lat1", "lon1", "knots", "course", "s")


@query(f"WITH p AS ({_POINT}) SELECT event_id, round((degrees(atan2(sin(radians(lon2) - radians(lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2) - radians(lon1)))) + 360) % 360, 4) AS bearing, round({_WAY[0]}, 6) AS lat, round({_WAY[1]}, 6) AS lon FROM p")
def F01_bearing_and_dead_reckoning(spark, d):
    p = spark.sql(_POINT.replace("FROM events", "FROM {events}"), events=_t(spark, d, "events"))
    x = {n: F.col(n).cast("double") for n in ("lat1", "lon1", "lat2", "lon2", "knots", "course", "s")}
    lat, lon = X.dead_reckon(x["lat1"], x["lon1"], x["knots"], x["course"], x["s"])
    return p.select("event_id", F.round(X.bearing_deg(x["lat1"], x["lon1"], x["lat2"], x["lon2"]), 4).alias("bearing"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


_SESSIONS = "s AS (SELECT *, sum(CASE WHEN ts0 IS NULL OR ts >= ts0 + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ts0 FROM events))"


@query(f"WITH {_SESSIONS} SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k")
def X12_silence_sessions(spark, d):
    return S.sessions(_t(spark, d, "events"), "user_id", "ts", "12 hours")


@query("""SELECT * FROM (SELECT user_id, min(ts) FILTER (event_type = 'click') AS opened, min(ts) FILTER (event_type = 'click') + INTERVAL 7200 SECOND AS deadline, min(ts) FILTER (event_type = 'purchase') AS closed FROM events GROUP BY 1)
 WHERE opened IS NOT NULL AND deadline <= TIMESTAMP '2024-01-20' AND (closed IS NULL OR closed > deadline)""".replace("SELECT * FROM", "SELECT user_id, opened, deadline FROM", 1))
def X08_expire_holds(spark, d):
    kind = F.col("event_type")
    return S.expired(_t(spark, d, "events"), "user_id", "ts", kind == "click", kind == "purchase", 7200, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


_TRUTH = f"{_SESSIONS}, t AS (SELECT user_id, min(ts) AS start, max(ts) AS stop FROM s GROUP BY user_id, k), f AS (SELECT user_id, start + INTERVAL 1800 SECOND AS start, stop + INTERVAL 1800 SECOND AS stop FROM t WHERE user_id % 3 > 0)"
_SEC = "least(epoch_us(t.stop), epoch_us(f.stop)) - greatest(epoch_us(t.start), epoch_us(f.start))"


@query(f"""WITH {_TRUTH}, o AS (SELECT t.user_id, t.start, {_SEC} AS sec, epoch_us(t.stop) - epoch_us(t.start) AS len FROM t JOIN f ON f.user_id = t.user_id), b AS (SELECT user_id, start, max(sec) AS overlap_us FROM o WHERE sec > 0 AND sec >= 0.5 * len GROUP BY 1, 2)
 SELECT user_id, start, overlap_us FROM t LEFT JOIN b USING (user_id, start)""")
def J11_best_overlap(spark, d):
    truth = S.sessions(_t(spark, d, "events"), "user_id", "ts", "12 hours").withColumnRenamed("last", "stop")
    later = [(F.col(x) + F.expr("INTERVAL 1800 SECONDS")).alias(x) for x in ("start", "stop")]
    return S.best_overlap(truth, truth.filter("user_id % 3 > 0").select("user_id", *later), "user_id", "start", "stop", 0.5)


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS has_large FROM customer")
def J21_with_exists_flag(spark, d):
    keys = _t(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_hit", F.lit(True))
    return _t(spark, d, "customer").join(keys, "c_custkey", "left").select("c_custkey", F.coalesce("_hit", F.lit(False)).alias("has_large"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def J13_latest_per_key(spark, d):
    """One aggregate with a combine before the shuffle; no key's history is sorted."""
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey"))
    return _t(spark, d, "orders").groupBy("o_custkey").agg(best.alias("x")).select("o_custkey", "x.*")


_DUAL = "SELECT o_orderkey, o_totalprice AS old, CASE WHEN o_orderkey % 40 = 0 THEN NULL WHEN o_orderkey % 25 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) + 1 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS new FROM orders"


@query(f"WITH d AS ({_DUAL}) SELECT count(*) AS n, count(*) FILTER (new IS NOT DISTINCT FROM CAST(round(old * 100) AS BIGINT)) AS agree, count(*) FILTER (new IS NULL) AS lost, list_aggregate((list(o_orderkey ORDER BY o_orderkey) FILTER (new IS DISTINCT FROM CAST(round(old * 100) AS BIGINT)))[1:5], 'string_agg', ',') AS examples FROM d")
def J15_verify_dual(spark, d):
    up = F.round(F.col("old") * 100).cast("long")
    new = F.when(F.col("o_orderkey") % 40 == 0, None).when(F.col("o_orderkey") % 25 == 0, up + 1).otherwise(up)
    rows = _t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("old")).withColumn("new", new).withColumn("ok", F.col("new").eqNullSafe(up))
    wrong = rows.filter("not ok").orderBy("o_orderkey").limit(5).agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")), ",").alias("examples"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("agree"), F.count_if(F.col("new").isNull()).alias("lost")).join(F.broadcast(wrong), how="full", on=F.lit(True))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) < (150000.0, 0) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def P06_keyset_page(spark, d):
    """The page after a cursor (price, key), both falling."""
    after = (F.col("o_totalprice") < 150000.0) | ((F.col("o_totalprice") == 150000.0) & (F.col("o_orderkey") < 0))
    return _t(spark, d, "orders").filter(after).orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%er#0000001%' ORDER BY c_custkey LIMIT 20")
def P05_search(spark, d):
    fragment = "er#0000001".replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return _t(spark, d, "customer").filter(F.col("c_name").ilike(f"%{fragment}%")).orderBy("c_custkey").limit(20).select("c_custkey", "c_name")


@query("SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'unknown' WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 1000 THEN 'low' WHEN c_acctbal < 5000 THEN 'middle' ELSE 'high' END AS level FROM customer")
def P08_level_bins(spark, d):
    bal = F.col("c_acctbal")
    return _t(spark, d, "customer").select("c_custkey", F.when(bal.isNull(), "unknown").when(bal < 0, "negative").when(bal < 1000, "low").when(bal < 5000, "middle").otherwise("high").alias("level"))


@query("SELECT CASE WHEN event_type = 'view' THEN 'read' WHEN event_type = 'click' AND value > 50 THEN 'engaged' WHEN event_type IN ('purchase', 'signup') THEN 'converted' ELSE 'other' END AS activity, count(*) AS n FROM events GROUP BY 1")
def P01_map_activity(spark, d):
    kind = F.col("event_type")
    activity = F.when(kind == "view", "read").when((kind == "click") & (F.col("value") > 50), "engaged").when(kind.isin("purchase", "signup"), "converted").otherwise("other")
    return _t(spark, d, "events").groupBy(activity.alias("activity")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def U03_not_in_other(spark, d):
    other = _t(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return _t(spark, d, "customer").select("c_custkey").distinct().join(other, "c_custkey", "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id IS NOT NULL ORDER BY sha1(CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def T07_fixed_subset(spark, d):
    return _t(spark, d, "documents").filter("doc_id is not null").select("doc_id").orderBy(F.sha1(F.col("doc_id").cast("string")), "doc_id").limit(50)


@query("SELECT quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95, quantile_cont(ms, 0.99) AS p99, max(ms) AS most FROM (SELECT CAST(epoch_us(o_orderdate) / 1e6 % 977 AS DOUBLE) AS ms FROM orders)")
def A43_latency_percentiles(spark, d):
    ms = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6 % 977).alias("ms")
    at = F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return _t(spark, d, "orders").select(ms).agg(at.alias("p"), F.max("ms").alias("most")).select(*(F.col("p")[k].alias(n) for k, n in enumerate(("p50", "p95", "p99"))), "most")


@query("SELECT date_trunc('second', ts) AS second, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS sales, round(coalesce(count(*) FILTER (event_type = 'purchase') / nullif(count(*), 0), 0), 4) AS rate FROM events GROUP BY 1")
def A21_sale_ratios(spark, d):
    kind = F.col("event_type")
    sums = _t(spark, d, "events").groupBy(F.date_trunc("second", "ts").cast("timestamp_ntz").alias("second")).agg(F.count_if(kind == "view").alias("views"), F.count_if(kind == "purchase").alias("sales"), F.count(F.lit(1)).alias("n"))
    return sums.select("second", "views", "sales", F.round(F.coalesce(F.try_divide("sales", "n"), F.lit(0.0)), 4).alias("rate"))
