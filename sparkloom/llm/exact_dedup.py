"""Exact deduplication with a split for heavy hitters, in DataFrame functions only.

Every text's SHA-256 is written once. A mergeable Misra-Gries summary of the digests (Spark's approx_top_k, whose
counters are bounded whatever the input) names the digests that may be frequent; an exact count verifies them, and the
verified ones, a bounded number of rows, are broadcast so that their copies are settled on the map side. All other
digests are shuffled, each of them rarer than the summary's error allows, so no partition is much larger than others.

Texts are equal when identical; a null counts as empty. Of equal texts the row with the largest key stays, a null key
last; of repeated rows with the same key and text one stays. An empty table gives an empty result. Other columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import marked, ready, stored, whole_row

#: Counters of the summary, and how many digests it may name. A digest with over 3.5 / COUNTERS of the rows is named.
COUNTERS, NAMED = 16_384, 4_096
#: Verified digests with so many rows or more are settled by broadcast.
FREQUENT = 8


def _best(key: str) -> Column:
    """Compares rows of equal texts: null keys are least; the row number decides between repeated rows."""
    return F.max(F.struct(F.col(key).isNotNull(), F.col(key), F.col("row_id")))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row_id, digest): one row for each row of docs, as a written table."""
    sha = F.unhex(F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256))
    return stored(docs.select(F.col(key), sha.alias("digest")).withColumn("row_id", F.monotonically_increasing_id()))


def frequent(rows: DataFrame, key: str) -> DataFrame:
    """(digest, best, group_size) of at most NAMED digests: named by the summary, then counted exactly."""
    named = rows.agg(F.expr(f"approx_top_k(hex(digest), {NAMED}, {COUNTERS})").alias("top")).select(F.explode("top").alias("x"))
    named = named.select(F.unhex("x.item").alias("digest"), F.col("x.count").alias("estimate")).filter(F.col("estimate") >= FREQUENT).select("digest")
    counted = rows.join(F.broadcast(named), "digest").groupBy("digest").agg(_best(key).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return stored(counted.filter(F.col("group_size") >= FREQUENT))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256): a row for each row of docs."""
    ready(docs.sparkSession)
    rows = digests(docs, key, text)
    winners = frequent(rows, key)
    hot = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # aggregated partly before the shuffle, then joined back
    groups = rest.groupBy("digest").agg(_best(key).alias("best"), F.count(F.lit(1)).alias("group_size"))
    rest = rest.join(groups.hint("merge"), "digest").select("digest", key, "row_id", "best", "group_size")
    both = hot.select(rest.columns).unionByName(rest)
    return both.select(
        key,
        F.col(f"best.{key}").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("best.row_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns. Copies of frequent texts go on the map side; of the
    others, rows whose text is surely the only one stay where they are and the rest is shuffled by digest."""
    ready(docs.sparkSession)
    rows = digests(docs, key, text)
    winners = frequent(rows, key)
    repeated = stored(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lower(F.hex("digest")).alias("digest")))
    best = F.broadcast(winners.select(F.lower(F.hex("digest")).alias("digest"), F.col(f"best.{key}").alias("best"), F.lit(True).alias("hot")))
    sha = F.sha2(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"), 256)
    left = docs.select(whole_row(docs), F.col(key).alias("key"), sha.alias("digest")).join(best, "digest", "left")
    left = left.filter(F.col("hot").isNull() | F.col("key").eqNullSafe(F.col("best")))
    told = marked(left, F.col("digest"), repeated, F.col("digest"))
    first = F.row_number().over(Window.partitionBy("digest").orderBy(F.col("key").desc_nulls_last()))
    one = told.filter("_marked").withColumn("first", first).filter("first = 1")
    return told.filter("not _marked").select("row.*").unionByName(one.select("row.*"))
