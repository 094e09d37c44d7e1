"""Queries of stateful and incremental operators, each beside the SQL of its batch meaning. Commands, fragments and
batches are made from `events`; the stream twins read the same rows as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fragments, incremental, reservations
from ..sources import runs
from ..sources.scratch import scratch
from ..streaming import detection, sink
from . import silence
from .tables import _t, query

_COMMANDS = """SELECT 'e' || event_id % 97 AS sale, event_id AS seq, ts AS at, CASE event_type WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'release' WHEN 'signup' THEN 'adjust' ELSE 'reserve' END AS kind,
 'u' || user_id % 5 AS "user", 's' || event_id % 3 AS section, CASE WHEN event_id % 71 = 3 THEN NULL WHEN event_type = 'signup' THEN event_id % 5 - 2 ELSE event_id % 4 END AS qty, 'k' || event_id % 3200 % 6 AS "key" FROM events"""
_SECTIONS = "SELECT 'e' || event_id % 97 AS sale, 's' || event_id % 2 AS section, count(*) % 7 + 3 AS total FROM events GROUP BY 1, 2"
_SALES = "SELECT 'e' || event_id % 97 AS sale, min(ts) + INTERVAL 2 DAY AS opens, 100000 + event_id % 97 * 4000 AS hold_seconds, 5 AS most FROM events GROUP BY event_id % 97"
_TTL = 864_000.0

_TAKE = "STRUCT(u VARCHAR, k VARCHAR, s VARCHAR, q BIGINT, ends DOUBLE, forget DOUBLE, st VARCHAR)[]"
_REPLAY = f"""WITH RECURSIVE c0 AS ({_COMMANDS}), c AS (SELECT sale, seq, epoch_us("at") / 1e6 AS tm, kind, "user" AS u, section, qty, "key" AS k, total, epoch_us(opens) / 1e6 AS opens, CAST(hold_seconds AS DOUBLE) AS hold, most,
  row_number() OVER (PARTITION BY sale ORDER BY "at", seq) AS n FROM c0 LEFT JOIN ({_SECTIONS}) USING (sale, section) LEFT JOIN ({_SALES}) USING (sale) WHERE NOT (kind IN ('reserve', 'adjust') AND qty IS NULL)),
 r AS (SELECT DISTINCT sale, 0::BIGINT AS n, []::{_TAKE} AS held, []::STRUCT(s VARCHAR, d BIGINT)[] AS moves, NULL::BIGINT AS seq, NULL::VARCHAR AS verdict, NULL::BIGINT AS available FROM c
  UNION ALL
  SELECT sale, n, held, moves, seq, verdict, CASE WHEN total IS NOT NULL THEN CAST(total + coalesce(list_sum([m.d for m in moves if m.s = section]), 0) - coalesce(list_sum([e.q for e in held if e.s = section AND e.st IN ('held', 'sold')]), 0) AS BIGINT) END FROM (
   SELECT sale, n, seq, section, total, verdict, CASE WHEN verdict IN ('stock_added', 'stock_corrected') THEN list_append(moves, {{'s': section, 'd': qty}}) ELSE moves END AS moves,
    CASE WHEN verdict = 'held' THEN list_append(held, {{'u': u, 'k': k, 's': section, 'q': qty, 'ends': tm + hold, 'forget': tm + greatest(hold, {_TTL}), 'st': 'held'}})
     WHEN verdict IN ('confirmed', 'released') THEN list_transform(held, lambda e: CASE WHEN e.u = u AND e.k = k AND e.st = 'held' THEN {{'u': e.u, 'k': e.k, 's': e.s, 'q': e.q, 'ends': e.ends, 'forget': e.forget, 'st': CASE verdict WHEN 'confirmed' THEN 'sold' ELSE 'released' END}} ELSE e END) ELSE held END AS held FROM (
    SELECT *, CASE WHEN kind = 'adjust' THEN CASE WHEN total IS NULL THEN 'no_such_section' WHEN qty = 0 THEN 'invalid_delta' WHEN -qty > avail THEN 'correction_below_committed' WHEN qty > 0 THEN 'stock_added' ELSE 'stock_corrected' END
     WHEN kind = 'confirm' THEN CASE coalesce(prior, '') WHEN '' THEN 'no_such_reservation' WHEN 'expired' THEN 'hold_expired' WHEN 'released' THEN 'already_closed' ELSE 'confirmed' END
     WHEN kind = 'release' THEN CASE coalesce(prior, '') WHEN '' THEN 'no_such_reservation' WHEN 'expired' THEN 'hold_expired' WHEN 'sold' THEN 'already_closed' ELSE 'released' END
     WHEN prior IS NOT NULL THEN 'replayed' WHEN total IS NULL THEN 'no_such_section' WHEN qty <= 0 THEN 'invalid_quantity' WHEN qty > avail THEN 'sold_out' WHEN tm < opens THEN 'not_on_sale'
     WHEN coalesce(list_sum([e.q for e in held if e.u = u AND e.st = 'sold']), 0) + qty > most THEN 'limit_exceeded' WHEN len([e for e in held if e.u = u AND e.st = 'held']) > 0 THEN 'already_holding' ELSE 'held' END AS verdict FROM (
     SELECT *, total + coalesce(list_sum([m.d for m in moves if m.s = section]), 0) - coalesce(list_sum([e.q for e in held if e.s = section AND e.st IN ('held', 'sold')]), 0) AS avail, list_last([e.st for e in held if e.u = u AND e.k = k AND e.forget > tm]) AS prior FROM (
      SELECT c.*, r.moves, list_transform(r.held, lambda e: CASE WHEN e.st = 'held' AND e.ends <= c.tm THEN {{'u': e.u, 'k': e.k, 's': e.s, 'q': e.q, 'ends': e.ends, 'forget': e.forget, 'st': 'expired'}} ELSE e END) AS held FROM r JOIN c ON c.sale = r.sale AND c.n = r.n + 1)))))
 SELECT sale, seq, verdict, available FROM r WHERE n > 0 UNION ALL SELECT sale, seq, 'malformed', NULL FROM c0 WHERE kind IN ('reserve', 'adjust') AND qty IS NULL"""


def _spark(sql: str) -> str:
    return sql.replace('"', "`")


def _sales(spark, d):
    events = _t(spark, d, "events")
    return [spark.sql(_spark(q.replace("FROM events", "FROM {events}")), events=events) for q in (_COMMANDS, _SECTIONS, _SALES)]


@query(_REPLAY)
def X13_replay_attempts(spark, d):
    """Reservations of made-up sales: 97 sales, 13 users, two sections that exist and one that doesn't."""
    return reservations.replay(*_sales(spark, d), _TTL)


_PARTS = """SELECT 'st' || user_id % 40 AS station, 1 + user_id % 3 AS total, CASE WHEN event_id % 29 = 0 THEN 1 + event_id % 5 WHEN event_id % 23 = 0 THEN 9 ELSE 1 + rank % (1 + user_id % 3) END AS num, ts, event_id AS tie, props AS payload
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 120 ORDER BY ts, event_id) - 1 AS rank FROM events)"""
_WAIT = 150_000.0

_JOINED = f"""WITH p AS (SELECT *, epoch_us(ts) / 1e6 AS tm FROM ({_PARTS})), u AS (SELECT max(tm) - 86400 AS until FROM p), g AS (SELECT * FROM p WHERE num BETWEEN 1 AND total),
 a AS (SELECT *, sum(CASE WHEN num = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY station, total ORDER BY tm, tie ROWS UNBOUNDED PRECEDING) AS run FROM g),
 b AS (SELECT *, row_number() OVER w AS place, first_value(tm) OVER w AS began, max(run) OVER (PARTITION BY station, total) AS newest FROM a WINDOW w AS (PARTITION BY station, total, run ORDER BY tm, tie)),
 f AS (SELECT *, coalesce(run > 0 AND num = place AND tm - began <= {_WAIT}, false) AS ok, tm - began > {_WAIT} AS late FROM b),
 h AS (SELECT *, min(CASE WHEN NOT ok THEN place END) OVER (PARTITION BY station, total, run) AS bad FROM f),
 i AS (SELECT *, coalesce(place < bad, true) OR (run > 0 AND place = bad AND NOT late AND bad <= total) AS mine, run > 0 AND coalesce(place = bad, false) AND NOT late AND bad <= total AS misfit, coalesce(place = bad, false) AND late AS cut FROM h),
 j AS (SELECT station, total, run, arg_min(tie, (tm, tie)) FILTER (mine) AS first_tie, min(tm) AS began, count(*) FILTER (mine) AS n_parts, string_agg(payload, '' ORDER BY place) FILTER (mine) AS payload, bool_or(misfit) AS misfit, bool_or(cut) AS cut, any_value(newest) AS newest FROM i WHERE run > 0 GROUP BY ALL)
 SELECT station, first_tie, outcome, n_parts, payload FROM (SELECT *, CASE WHEN misfit THEN 'fragment_out_of_order' WHEN n_parts = total THEN 'complete' WHEN run < newest OR cut OR began + {_WAIT} < until THEN 'incomplete' END AS outcome FROM j, u) WHERE outcome IS NOT NULL
 UNION ALL SELECT station, tie, 'orphan_fragment', 1, payload FROM i WHERE NOT (mine AND run > 0) UNION ALL SELECT station, tie, 'fragment_out_of_range', 1, payload FROM p WHERE NOT (num BETWEEN 1 AND total)"""


def _parts(spark, d):
    return spark.sql(_PARTS.replace("FROM events", "FROM {events}"), events=_t(spark, d, "events"))


@query(_JOINED)
def X06_fragment_join(spark, d):
    """Parts of messages of 40 stations, some numbers wrong; a message waits for 150,000 seconds."""
    parts = _parts(spark, d)
    until = parts.agg(F.max(fragments.seconds("ts"))).first()[0] - 86_400
    return fragments.join_fragments(parts, ["station"], "total", "num", "ts", "tie", "payload", _WAIT, until)


#: Events arrive in four files, one in 37 a file late; the fourth holds what is left.
_ARRIVAL = "least(3, CASE WHEN ts < TIMESTAMP '2024-01-09' THEN 0 WHEN ts < TIMESTAMP '2024-01-17' THEN 1 WHEN ts < TIMESTAMP '2024-01-24' THEN 2 ELSE 3 END + CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END)"
_PASSES = " UNION ALL BY NAME ".join(
    f"SELECT {k} AS pass, * FROM (WITH {silence._AT.replace('FROM events', f'FROM (SELECT * FROM events WHERE {_ARRIVAL} <= {k})')}, {silence._GRID}, {silence._SILENT}, {silence._NEAR}, {silence._HEARD}, {silence._JUDGED} SELECT {silence._SAID}, since FROM j, s)" for k in range(4)
)
_SINCE = " UNION ALL ".join(f"SELECT {k} AS pass, max(ts) - INTERVAL {int(silence._RULES.lookback_h)} HOUR AS since FROM events WHERE {_ARRIVAL} <= {k}" for k in range(4))


@query(f"""WITH p AS MATERIALIZED ({_PASSES}), w AS ({_SINCE}), k AS (SELECT thing, silent_from, min(pass) AS first_batch, max(pass) AS seen FROM p GROUP BY 1, 2),
 l AS (SELECT k.*, (SELECT max(pass) FROM w WHERE w.since <= k.silent_from) AS last FROM k)
 SELECT p.* EXCLUDE (pass, since), first_batch, seen < last AS withdrawn FROM l JOIN p ON p.thing = l.thing AND p.silent_from = l.silent_from AND p.pass = l.seen""")
def X11_detect_pass(spark, d):
    """Events as reports in four batches, some of them late: silences found, changed and withdrawn batch by batch."""
    folder = scratch(spark)
    reports = spark.sql(silence._POS.replace("FROM events", ", CAST(" + _ARRIVAL + " AS INT) AS arrival FROM {events}"), events=_t(spark, d, "events"))
    kinds = {x: "double" for x in ("lat", "lon", "knots", "course")}
    reports = reports.select("thing", "ts", *(F.col(x).cast(k).alias(x) for x, k in kinds.items()), "arrival")
    for k in range(4):
        reports.filter(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(reports.drop("arrival").schema).parquet(f"{folder}/in")
        found = detection.follow(stream, folder, silence._RULES)
    return silence.said(found).drop("changed_batch", "day")


@query("SELECT 'r2' AS run, 'r3' AS previous, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_orderstatus")
def S11_publish_run(spark, d):
    """Three runs of a summary, the second one published twice, then one step back."""
    root, orders = scratch(spark), _t(spark, d, "orders")
    for run, rows in (("r1", orders.filter("o_orderkey % 2 = 0")), ("r2", orders.filter("o_orderkey % 3 <> 0")), ("r2", orders.filter("false")), ("r3", orders)):
        runs.publish_run(rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), root, run)
    now = runs.rollback(spark, root)
    return runs.current(spark, root).select(F.lit(now["run"]).alias("run"), F.lit(now["previous"]).alias("previous"), "o_orderstatus", "n", "total")


@query("""SELECT event_id, user_id, ts, CASE WHEN event_id % 59 = 0 THEN 3 WHEN ts < TIMESTAMP '2024-01-20' THEN 1 ELSE 2 END AS batch FROM events""")
def X09_rebuild_affected_days(spark, d):
    """Three batches: 20 days, the rest with copies of old events, and late events with more copies; each is followed by
    a rebuild of the days it touches."""
    bronze, target, events = scratch(spark), scratch(spark), _t(spark, d, "events").select("event_id", "user_id", "ts")
    late, early = F.col("event_id") % 59 == 0, F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")
    copies = events.filter(early & (F.col("event_id") % 41 == 0) & ~late)
    held = 0
    for batch, rows in ((1, events.filter(early & ~late)), (2, events.filter(~early & ~late).unionByName(copies)), (3, events.filter(late).unionByName(copies))):
        incremental.append_batch(rows, bronze, batch, F.to_date("ts"))
        held = incremental.rebuild_affected_days(spark, bronze, target, ["event_id"], ["ts"], held)
    return spark.read.parquet(target).select("event_id", "user_id", "ts", "batch")


#: Records made from events: three topics, redelivered positions, and poison of many kinds.
_BODY = """CASE WHEN event_id % 13 = 0 THEN '{"cid": "x", "mm' WHEN event_id % 101 = 0 THEN '[1, 2]' ELSE concat('{"cid": "', event_id, '", "reason": "', CASE WHEN event_id % 2 = 0 THEN 'bad_checksum' ELSE 'late' END, '", "stage": "', CASE WHEN event_id % 7 = 0 THEN 'nowhere' ELSE 'decode' END, '", ',
 CASE WHEN event_id % 17 = 0 THEN '' ELSE '"source": "feed", ' END, '"received_at": ', CASE WHEN event_id % 97 = 0 THEN '1e300' ELSE '1704067200.5' END, ', "mmsi": ', CASE WHEN event_id % 19 = 0 THEN '"abc"' WHEN event_id % 23 = 0 THEN '111222333' ELSE CAST(200000000 + user_id AS STRING) END, ', "lat": ',
 CASE WHEN event_id % 29 = 0 THEN '91' WHEN event_id % 31 = 0 THEN '-90.5' WHEN event_id % 37 = 0 THEN 'null' ELSE CAST(user_id % 80 AS STRING) END, ', "lon": ', CASE WHEN event_id % 41 = 0 THEN '"12"' ELSE '10.25' END, CASE WHEN event_id % 43 = 0 THEN ', "sog": "fast"' WHEN event_id % 47 = 0 THEN ', "heading": 12.5' ELSE ', "sog": 7.5, "heading": null' END,
 CASE WHEN event_id % 53 = 0 THEN '' ELSE concat(', "ts": ', 1704067200 + user_id * 1000 + event_id % 10 * 60) END, ', "msg_type": ', CASE WHEN event_id % 59 = 0 THEN '5' ELSE '1' END, '}') END"""
_TOPIC = "CASE event_type WHEN 'signup' THEN 'static' WHEN 'error' THEN 'dead' ELSE CASE WHEN event_id % 67 = 0 THEN 'other' ELSE 'position' END END"
_RECORD = [f"{_TOPIC} AS topic", f"{_BODY} AS body", "CAST(event_id AS STRING) AS cid", "event_id % 3 AS part"]


def _n(field):
    """SQL: the field of j is a number."""
    return f"coalesce(json_type(j, '$.{field}'), '') IN ('BIGINT', 'UBIGINT', 'DOUBLE')"


_LANDED = f"""WITH r AS (SELECT {', '.join(_RECORD).replace('STRING', 'VARCHAR')} FROM events), v AS (SELECT *, json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT' AS ok, CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS j FROM r),
 f AS (SELECT *, CASE WHEN NOT ok THEN 'unparseable_record' WHEN NOT (coalesce(json_type(j, '$.source'), '') = 'VARCHAR' AND {_n('received_at')}) THEN 'missing_envelope'
  WHEN NOT (coalesce(json_type(j, '$.mmsi'), '') IN ('BIGINT', 'UBIGINT') AND coalesce(TRY_CAST(json_extract_string(j, '$.mmsi') AS DOUBLE) BETWEEN 200000000 AND 799999999, false)) THEN 'non_vessel_mmsi' END AS base, CASE WHEN {_n('lat')} THEN TRY_CAST(json_extract_string(j, '$.lat') AS DOUBLE) END AS lat, CASE WHEN {_n('lon')} THEN TRY_CAST(json_extract_string(j, '$.lon') AS DOUBLE) END AS lon FROM v),
 k AS (SELECT *, CASE topic WHEN 'dead' THEN CASE WHEN NOT ok OR json_extract_string(j, '$.stage') NOT IN ('decode', 'validate', 'sink') THEN 'malformed_dead_letter' ELSE json_extract_string(j, '$.reason') END WHEN 'static' THEN coalesce(base, CASE WHEN TRY_CAST(json_extract_string(j, '$.received_at') AS DOUBLE) > 253402300799 THEN 'sink_refuses_received_at' END) WHEN 'position' THEN
   CASE WHEN base IS NOT NULL THEN base WHEN lat IS NULL OR lon IS NULL THEN 'missing_position' WHEN lat = 91 OR lon = 181 THEN 'position_unavailable' WHEN NOT (abs(lat) <= 90 AND abs(lon) <= 180) THEN 'position_out_of_range' WHEN abs(lat) < 0.001 AND abs(lon) < 0.001 THEN 'null_island'
    WHEN json_type(j, '$.sog') = 'VARCHAR' THEN 'sog_out_of_range' WHEN json_type(j, '$.heading') = 'DOUBLE' THEN 'heading_out_of_range' WHEN NOT {_n('ts')} THEN 'missing_timestamp' WHEN TRY_CAST(json_extract_string(j, '$.ts') AS DOUBLE) > 1706000120 THEN 'timestamp_in_future' WHEN json_extract_string(j, '$.msg_type') = '5' THEN 'bad_msg_type'
    WHEN TRY_CAST(json_extract_string(j, '$.received_at') AS DOUBLE) > 253402300799 THEN 'sink_refuses_received_at' END ELSE 'unknown_topic' END AS reason FROM f),
 s AS (SELECT *, CASE WHEN reason IS NOT NULL OR topic = 'dead' THEN 'dead' WHEN topic = 'static' THEN 'static' ELSE 'position' END AS sink FROM k)
 SELECT cid, sink, reason FROM s WHERE sink <> 'position' UNION ALL SELECT arg_min(cid, (part, cid)), 'position', NULL FROM s WHERE sink = 'position' GROUP BY json_extract_string(j, '$.mmsi'), json_extract_string(j, '$.ts')"""


@query(_LANDED)
def X04_poison_isolation(spark, d):
    """Records in three batches, one of them delivered again: each lands in one of three tables with its reason."""
    folder, events = scratch(spark), _t(spark, d, "events")
    records = events.selectExpr(*_RECORD)
    # the stream takes what has come since its last run as one batch, in as many tasks as there are files
    for part in (0, 1, 2):
        records.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(records.drop("part").schema).parquet(f"{folder}/in")
        landed = sink.land(stream, folder, F.lit(1_706_000_000.0))
    landed.absorb(records.filter("part = 1").drop("part"), 1)
    none = F.lit(None).cast("string").alias("reason")
    good = [landed.table(t).select("cid", F.lit(s).alias("sink"), none) for t, s in (("positions", "position"), ("statics", "static"))]
    return good[0].unionByName(good[1]).unionByName(landed.table("dead").select("cid", F.lit("dead").alias("sink"), "reason"))


@query("""WITH j AS (SELECT event_id % 11 AS sale, user_id AS "user", min(ts) AS tm FROM events GROUP BY 1, 2), s AS (SELECT event_id % 11 AS sale, min(ts) + INTERVAL 12 DAY AS opens, event_id % 11 % 3 + 1 AS rate FROM events GROUP BY event_id % 11),
 r AS (SELECT j.sale, "user", rate, row_number() OVER (PARTITION BY j.sale ORDER BY tm >= opens, CASE WHEN tm < opens THEN md5('draw:' || j.sale || ':' || "user") END NULLS FIRST, CASE WHEN tm >= opens THEN tm END NULLS FIRST, "user") - 1 AS place FROM j JOIN s ON s.sale = j.sale) SELECT sale, "user", place, place // rate AS second FROM r""")
def X14_admission_schedule(spark, d):
    """Queues of eleven sales: the lobby drawn, later ones by arrival."""
    events = _t(spark, d, "events")
    joins = events.selectExpr("event_id % 11 AS sale", "user_id AS user", "ts AS at")
    sales = events.groupBy((F.col("event_id") % 11).alias("sale")).agg((F.min("ts") + F.expr("INTERVAL 12 DAYS")).alias("opens")).withColumn("rate", F.col("sale") % 3 + 1)
    return reservations.admission_schedule(joins, sales, "draw")
