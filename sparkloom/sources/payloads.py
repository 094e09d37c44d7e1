"""Nested payloads flattened in one pass: bundles of responses to listings, gaps and refused parts.

A bundle is a server's snapshot: a JSON array of responses, each for one requested item, with a status and a page, the
page itself JSON text: an array of orders. Every part ends in one of three outputs:

listings     orders that pass the rules, typed
gaps         requests without a page: the status that came instead, -1 for a page that can't be read
quarantine   what was refused, with a reason and the text: unknown_server and corrupt_payload for bundles and responses,
             unparseable_body for pages, and for orders bad_type (also: no object), missing_field, type_mismatch,
             unknown_item, non_positive_price, bad_volume, bad_timestamp, duplicate (in its snapshot; the first stays)

Numbers may be quoted. The parts are written once, so the three outputs cost one parse. Bundles are dealt as they are
read; the only shuffle is by (server, snapshot, order) for duplicates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.validation import first_failure
from .scratch import scratch

c = F.col
BUNDLE = ["server_id", "snapshot_ts", "raw_sha"]
REQUIRED = {"order_id": "bigint", "type_id": "bigint", "price": "double", "volume_remain": "double", "volume_total": "double", "is_buy_order": "boolean", "issued": "string", "duration": "int"}


@dataclass(frozen=True)
class Bundles:
    listings: DataFrame
    gaps: DataFrame
    quarantine: DataFrame


def _elements(text: F.Column) -> F.Column:
    """The elements of a JSON array as texts, null where the text is no array."""
    return F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>"))


def _kind(v: str, path: str) -> F.Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def order_bundles(payloads: DataFrame, items: DataFrame, servers: DataFrame) -> Bundles:
    """payloads: server_id, snapshot_ts, raw_sha, body. items: item_id. servers: server_id."""
    known = servers.select("server_id").distinct().withColumn("known_server", F.lit(True))
    rows = payloads.select(*BUNDLE, "body").join(known, "server_id", "left").withColumn("responses", F.when(c("known_server"), _elements(c("body"))))
    whole = F.when(c("known_server").isNull(), "unknown_server").when(c("responses").isNull(), "corrupt_payload")
    each = rows.select(*BUNDLE, whole.alias("bundle_reason"), F.substring("body", 1, 500).alias("bundle_text"), F.posexplode_outer(F.when(whole.isNull(), c("responses"))).alias("at", "response"))
    # an empty array of responses has nothing to tell
    each = each.filter("bundle_reason is not null or response is not null or at is not null").withColumn("v", F.try_parse_json("response"))
    asked = F.when(F.coalesce(_kind("v", "$.type_id") == "BIGINT", F.lit(False)), F.try_variant_get("v", "$.type_id", "bigint"))
    each = each.withColumns({"item_id": asked, "status": F.coalesce(F.try_variant_get("v", "$.status", "int"), F.lit(0)), "page": F.try_variant_get("v", "$.body", "string")})
    no_page = c("item_id").isNotNull() & ((c("status") != 200) | c("page").isNull())
    each = each.withColumn("orders", F.when(c("item_id").isNotNull() & ~no_page, _elements(c("page"))))
    unread = c("item_id").isNotNull() & ~no_page & c("orders").isNull()
    reason = F.coalesce("bundle_reason", F.when(c("item_id").isNull(), "corrupt_payload"), F.when(unread, "unparseable_body"))
    gap = F.when(c("bundle_reason").isNull() & no_page, c("status")).when(c("bundle_reason").isNull() & unread, -1)
    told = F.coalesce(c("bundle_text"), F.lit(""))
    text = F.when(c("bundle_reason").isNotNull(), told).when(unread, F.substring("page", 1, 500)).otherwise(F.substring("response", 1, 2000))
    flat = each.select(*BUNDLE, "at", "item_id", reason.alias("part_reason"), gap.alias("gap_status"), text.alias("part_text"), F.posexplode_outer("orders").alias("place", "row"))
    flat = flat.filter("part_reason is not null or gap_status is not null or place is not null").withColumn("r", F.when(c("place").isNotNull(), F.try_parse_json(F.coalesce("row", F.lit("null")))))
    flat = flat.withColumns({f"raw_{n}": F.try_variant_get("r", f"$.{n}", "string") for n in [*REQUIRED, "location_id"]})
    flat = flat.withColumns({n: c(f"raw_{n}").try_cast(t) for n, t in [*REQUIRED.items(), ("location_id", "bigint")]}).withColumn("issued_at", F.try_to_timestamp(F.regexp_replace("issued", "[TZ]", " ")))
    number = flat.join(items.select(c("item_id").alias("type_id")).distinct().withColumn("known_item", F.lit(True)), "type_id", "left")
    missing = F.lit(False)
    wrong = F.lit(False)
    for n in REQUIRED:
        missing = missing | c(f"raw_{n}").isNull()
        wrong = wrong | c(n).isNull()
    rules = [
        ("bad_type", ~F.coalesce(F.schema_of_variant("r").startswith("OBJECT"), F.lit(False))),
        ("missing_field", missing),
        ("bad_type", wrong),
        ("type_mismatch", c("type_id") != c("item_id")),
        ("unknown_item", c("known_item").isNull()),
        ("non_positive_price", ~(c("price") > 0) | c("price").isin(float("inf"))),
        ("bad_volume", (c("volume_remain") < 0) | (c("volume_total") <= 0) | (c("volume_remain") > c("volume_total")) | (c("volume_remain") != F.floor("volume_remain"))),
        ("bad_timestamp", c("issued_at").isNull() | (c("issued_at") > c("snapshot_ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR"))),
    ]
    judged = number.withColumn("reason", F.when(c("place").isNull(), c("part_reason")).otherwise(first_failure(rules)))
    # what goes on: typed fields, and a text once, that of the part or of the order; a part's is not repeated with its orders
    told = F.when(c("place").isNull(), c("part_text")).otherwise(F.substring("row", 1, 2000)).alias("text")
    typed = [n for n in REQUIRED if n not in ("type_id", "issued")]
    lean = judged.select(*BUNDLE, "at", "place", "item_id", "reason", "gap_status", told, *typed, "issued_at", "location_id")
    # only orders that passed compete: the others' keys are made their own
    w = Window.partitionBy("server_id", "snapshot_ts", F.when(c("reason").isNull() & c("place").isNotNull(), c("order_id")).otherwise(F.xxhash64("raw_sha", "at", "place"))).orderBy("raw_sha", "at", "place")
    again = c("reason").isNull() & c("place").isNotNull() & (F.row_number().over(w) > 1)
    path = scratch(payloads.sparkSession)
    final = lean.withColumn("reason", F.when(again, "duplicate").otherwise(c("reason")))
    final.withColumn("text", F.when(c("reason").isNotNull(), c("text"))).write.parquet(path)
    parts = payloads.sparkSession.read.parquet(path)
    price = [c("price"), *(c(n).cast("bigint").alias(n) for n in ("volume_remain", "volume_total"))]
    return Bundles(
        parts.filter("place is not null and reason is null").select(*BUNDLE, "item_id", "order_id", c("is_buy_order").alias("is_buy"), *price, c("issued_at").alias("issued"), "duration", "location_id"),
        parts.filter("place is null and gap_status is not null").select(*BUNDLE, "item_id", c("gap_status").alias("status")),
        parts.filter("reason is not null").select(*BUNDLE, "item_id", "reason", c("text").alias("raw_row")),
    )
