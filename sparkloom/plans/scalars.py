"""Queries of the scalar functions over the given tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from .tables import _t, query


@query("""WITH e AS (SELECT event_id, ts, event_id * 37 % 61 AS s, CAST(floor(epoch(ts)) AS BIGINT) AS unix FROM events)
 SELECT event_id, CASE WHEN s BETWEEN 0 AND 59 THEN date_trunc('second', ts) - INTERVAL 1 SECOND * ((((unix + 5 - s) % 60) + 60) % 60 - 5) ELSE ts END AS fixed FROM e""")
def F03_fix_time(spark, d):
    return _t(spark, d, "events").select("event_id", X.fix_time(F.col("ts"), F.col("event_id") * 37 % 61).alias("fixed"))


@query("""WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n, CASE WHEN n >= 80 THEN 'gold' WHEN n >= 60 THEN 'silver' ELSE 'plain' END AS tier, round(-log2(n / (SELECT sum(n) FROM u)), 6) AS bits FROM u""")
def F10_tier_and_surprise(spark, d):
    counts = _t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    whole = F.broadcast(counts.agg(F.sum("n").alias("_all")))  # one row
    return counts.crossJoin(whole).select("user_id", "n", X.tier_of(F.col("n"), [("gold", 80), ("silver", 60)], "plain").alias("tier"), F.round(X.surprise_bits(F.col("n") / F.col("_all")), 6).alias("bits"))


_WORDS = {"le": ["le", "la", "les"], "der": ["der", "die", "das"], "el": ["el", "los", "las"]}


def _topic_sql() -> str:
    words = "regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}]+')"
    counts = ", ".join(f"{{'n': -len(list_filter({words}, lambda w: list_contains({ws}, w))), 'topic': '{t}'}}" for t, ws in _WORDS.items())
    return f"SELECT doc_id, array_to_string(list_transform(list_sort(list_filter([{counts}], lambda x: x.n < 0)), lambda x: x.topic), ',') AS topics FROM documents"


@query(_topic_sql())
def F14_tag_topics(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(X.tag_topics(F.col("text"), _WORDS), ",").alias("topics"))


@query("""WITH q AS (SELECT vec_id, CAST(greatest(0, least(1023, round((CAST(embedding[1] AS DOUBLE) + 0.25) / 0.5 * 1023))) AS INT) AS x, CAST(greatest(0, least(1023, round((CAST(embedding[2] AS DOUBLE) + 0.25) / 0.5 * 1023))) AS INT) AS y FROM embeddings)
 SELECT vec_id, x, y, CAST(list_sum(list_transform(range(0, 10), lambda k: (((x >> k) & 1) << (2 * k)) + (((y >> k) & 1) << (2 * k + 1)))) AS BIGINT) AS code FROM q""")
def F15_quantise_morton(spark, d):
    at = lambda i: X.quantise(F.col("embedding")[i].cast("double"), F.lit(-0.25), F.lit(0.5), 10)
    return _t(spark, d, "embeddings").select("vec_id", at(0).alias("x"), at(1).alias("y")).withColumn("code", X.morton(F.col("x"), F.col("y"), 10))


_SOFT = "list_transform({0}, lambda x: exp(x) / list_sum(list_transform({0}, lambda y: exp(y))))"


@query(f"""WITH h AS (SELECT vec_id, embedding[1:8]::DOUBLE[] AS a, embedding[9:16]::DOUBLE[] AS b FROM embeddings), s AS (SELECT vec_id, a, {_SOFT.format('a')} AS p, {_SOFT.format('b')} AS q FROM h)
 SELECT vec_id, round(list_sum(list_transform(range(1, 9), lambda i: p[i] * ln(p[i] / q[i]))), 9) AS kl, CAST(list_position(a, list_max(a)) - 1 AS INT) AS best FROM s""")
def F18_softmax_kl(spark, d):
    rows = _t(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).cast("array<double>").alias("a"), F.slice("embedding", 9, 8).cast("array<double>").alias("b"))
    return rows.select("vec_id", F.round(X.softmax_kl(F.col("a"), F.col("b")), 9).alias("kl"), X.argmax(F.col("a")).alias("best"))


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') || CASE WHEN count(*) FILTER (event_type = 'purchase') = 1 THEN ' purchase, ' ELSE ' purchases, ' END || CAST(floor(count(*) FILTER (event_type = 'purchase') / count(*) * 100) AS BIGINT) || '%' AS card FROM events GROUP BY 1")
def F20_render_card(spark, d):
    n = F.count_if(F.col("event_type") == "purchase")
    return _t(spark, d, "events").groupBy("user_id").agg(F.concat(X.plural(n, "purchase", "purchases"), F.lit(", "), X.percent_down(n / F.count(F.lit(1)))).alias("card"))


@query("SELECT event_id, CAST(floor((event_id * 7919 % 36000 / 100.0::DOUBLE - 180) / 0.5) AS BIGINT) AS col, CAST(floor((event_id * 104729 % 18000 / 100.0::DOUBLE - 90) / 0.5) AS BIGINT) AS row FROM events")
def F02_cell_of(spark, d):
    col, row = X.cell_of(F.expr("event_id * 104729 % 18000 / 100.0D - 90"), F.expr("event_id * 7919 % 36000 / 100.0D - 180"), 0.5)
    return _t(spark, d, "events").select("event_id", col.alias("col"), row.alias("row"))
