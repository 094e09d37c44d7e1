"""Messages that come in numbered parts, joined in order.

Parts of one message share a key and the number of parts (total) and arrive in order from 1. What a part can meet:

complete               its message's last part: the payloads joined
fragment_out_of_range  a number below 1 or above the total; it touches nothing
incomplete             a message whose parts end: its number 1 comes anew, or a part comes, or time passes, over
                       `timeout` seconds after its first part
fragment_out_of_order  a part that doesn't continue its message; it and the message's parts so far are dropped
orphan_fragment        a part with no message to continue

A message of which neither may be said yet at the end (`until`) is still open and not given out. A null in key, total,
number or time is fragment_out_of_range, a null payload counts as empty. Arrival is in the order of (ts, tie).
Everything is windows over one key's parts; a key with many parts is sorted by spilling, not held.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REASONS = ("complete", "incomplete", "fragment_out_of_order", "orphan_fragment", "fragment_out_of_range")
OUT = ["first_tie", "outcome", "n_parts", "payload"]


def seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def named(parts: DataFrame, keys: Sequence[str], total: str, num: str, ts: str, tie: str, payload: str) -> DataFrame:
    """(key, total, num, at, tie, payload) with all keys as one struct, so no column of parts can clash."""
    return parts.select(
        F.struct(*(F.col(k) for k in keys)).alias("key"),
        F.col(total).cast("int").alias("total"),
        F.col(num).cast("int").alias("num"),
        seconds(ts).alias("at"),
        F.col(tie).cast("long").alias("tie"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"),
    )


def in_range(keys: Sequence[str]) -> Column:
    known = F.col("num").between(1, F.col("total")) & F.col("at").isNotNull()
    for k in keys:
        known = known & F.col("key").getField(k).isNotNull()
    return F.coalesce(known, F.lit(False))


def refused(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.filter(~in_range(keys)).select("key", F.col("tie").alias("first_tie"), F.lit("fragment_out_of_range").alias("outcome"), F.lit(1).cast("long").alias("n_parts"), "payload")


def join_fragments(parts: DataFrame, keys: Sequence[str], total: str, num: str, ts: str, tie: str, payload: str, timeout: float, until: float) -> DataFrame:
    """(keys, first_tie, outcome, n_parts, payload): a row for each message and each part or message that was dropped."""
    rows = named(parts, keys, total, num, ts, tie, payload)
    good = rows.filter(in_range(keys))
    arrival = Window.partitionBy("key", "total").orderBy("at", "tie")
    # a run starts at each number 1 and holds all that comes before the next
    good = good.withColumn("run", F.sum((F.col("num") == 1).cast("long")).over(arrival.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("key", "total", "run").orderBy("at", "tie")
    good = good.withColumn("place", F.row_number().over(within)).withColumn("began", F.first("at").over(within))
    late = F.col("at") - F.col("began") > timeout
    follows = (F.col("run") > 0) & (F.col("num") == F.col("place")) & ~late
    # the first part that doesn't follow ends the message, and what comes after it is orphaned
    good = good.withColumn("late", late).withColumn("follows", follows).withColumn("bad", F.min(F.when(~follows, F.col("place"))).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    good = good.withColumn("breaks", F.col("bad") == F.col("place")).withColumn("whole", F.max(F.when(follows & F.col("bad").isNull(), F.col("place"))).over(within.rowsBetween(Window.unboundedPreceding, 0)) == F.col("total"))
    misfit = (F.col("run") > 0) & F.coalesce(F.col("breaks"), F.lit(False)) & ~F.col("late") & ~F.coalesce(F.col("whole"), F.lit(False))
    # a part that stands where it belongs, or is the one out of order, goes to its message; the others are orphans
    good = good.withColumn("of_message", (F.col("bad").isNull() | misfit)).withColumn("misfit", misfit)
    lone = good.filter("not of_message").select("key", F.col("tie").alias("first_tie"), F.lit("orphan_fragment").alias("outcome"), F.lit(1).cast("long").alias("n_parts"), "payload")
    last_run = F.max("run").over(Window.partitionBy("key", "total"))
    told = good.withColumn("newest", last_run).withColumn("lates", F.max((F.col("late") & F.col("breaks")).cast("int")).over(Window.partitionBy("key", "total", "run")))
    message = told.filter("of_message").groupBy("key", "total", "run").agg(
        F.min(F.struct("at", "tie")).alias("head"),
        F.count(F.lit(1)).alias("n_parts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "payload"))), lambda x: x["payload"]), "").alias("payload"),
        F.max("misfit").alias("misfit"),
        F.max("newest").alias("newest"),
        F.max("lates").alias("lates"),
    )
    over = (F.col("run") < F.col("newest")) | (F.col("lates") == 1) | (F.col("head.at") + timeout < until)
    outcome = F.when(F.col("misfit"), "fragment_out_of_order").when(F.col("n_parts") == F.col("total"), "complete").when(over, "incomplete")
    message = message.select("key", F.col("head.tie").alias("first_tie"), outcome.alias("outcome"), "n_parts", "payload").filter("outcome is not null")
    out = message.unionByName(lone).unionByName(refused(rows, keys))
    return out.select("key.*", *OUT)
