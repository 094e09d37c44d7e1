"""Release notes of an XML feed: items parsed one by one, bodies cut into one event for each deployment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
ITEM = "title string, description string, pubDate string, _corrupt string"
#: A section's heading with its day and number; a release without sections counts if its title says so. Fixed values.
SECTION = r"<h2[^>]*>(?:<strong>)?\s*Patch Notes for (\d{4}-\d{2}-\d{2})\.(\d+)\s*(?:</strong>)?</h2>"
VERSION, MAJOR, HOUR = r"Version ([A-Z]?\d+\.\d+)", "Expansion", 11
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def read_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, broken items as their text). The feed is cut at the items' ends as it is read, so a large file is dealt over
    tasks, and an item that is no XML costs only itself."""
    text = spark.read.option("lineSep", "</item>").text(path).select(F.regexp_extract("value", r"(?s)(<item(?:\s[^>]*)?>.*)$", 1).alias("item")).filter("item != ''")
    parsed = text.select(F.concat("item", F.lit("</item>")).alias("item")).withColumn("x", F.from_xml("item", ITEM, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    broken = c("x").isNull() | c("x._corrupt").isNotNull()
    return parsed.filter(~broken).select("x.title", "x.description", "x.pubDate"), parsed.filter(broken).select("item")


def plain(markup: Column) -> Column:
    """Markup without its tags, white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, "<[^>]+>", " "), r"\s+", " "))


def release_notes(items: DataFrame) -> DataFrame:
    """(event, released_at, version, title, notes, is_major): an event for each section, released at HOUR in the order of
    the section's number; an expansion without sections is one event at its own time. Of an event told twice the one with
    the longer notes stays."""
    body = F.coalesce(c("description"), F.lit(""))
    for entity, text in ENTITIES.items():
        body = F.replace(body, F.lit(entity), F.lit(text))
    title = F.trim(F.coalesce(c("title"), F.lit("")))
    version = F.regexp_extract(title, VERSION, 1)
    rows = items.select(title.alias("title"), F.when(version != "", version).alias("version"), "pubDate", body.alias("body"))
    cut = rows.withColumns({"days": F.regexp_extract_all("body", F.lit(SECTION), F.lit(1)), "numbers": F.regexp_extract_all("body", F.lit(SECTION), F.lit(2)), "texts": F.split("body", SECTION)})
    parts = cut.filter(F.size("days") > 0).select("title", "version", "texts", F.posexplode(F.arrays_zip("days", "numbers")).alias("at", "head"))
    event = F.concat_ws(".", c("head.days"), c("head.numbers"))
    minute = c("head.numbers").try_cast("long") - 1
    parts = parts.select(
        event.alias("event"),
        (F.try_to_timestamp(F.concat(c("head.days"), F.lit(f" {HOUR}:00:00"))) + F.make_dt_interval(mins=minute)).alias("released_at"),
        "version",
        F.when(c("title") != "", F.concat_ws(" · ", "title", event)).otherwise(F.concat(F.lit("Patch "), event)).alias("title"),
        plain(F.element_at("texts", c("at") + 2)).alias("notes"),
        F.lit(False).alias("is_major"),
    )
    name = F.lower(F.trim(F.regexp_replace(F.element_at(F.split("title", ":"), 1), "[^A-Za-z0-9]+", "-"), F.lit("-")))
    told = F.try_to_timestamp(F.regexp_replace(F.regexp_replace("pubDate", "^[A-Za-z]+, ", ""), " (GMT|UTC?|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    whole = cut.filter((F.size("days") == 0) & c("title").contains(MAJOR)).select(F.concat(F.lit("exp-"), name).alias("event"), told.alias("released_at"), "version", "title", plain(c("body")).alias("notes"), F.lit(True).alias("is_major"))
    both = parts.unionByName(whole.filter("released_at is not null"))
    best = both.groupBy("event").agg(F.max_by(F.struct("released_at", "version", "title", "notes", "is_major"), F.struct(F.length("notes"), "title", "notes")).alias("x"))
    return best.select("event", "x.*")


#: Kinds of a second provider's messages, and values from which on a field means "not known". Fixed values.
POSITION_KINDS, STATIC_KIND, UNKNOWN_FROM, SKEW_S = {"PositionReport": 1, "StandardClassBPositionReport": 18}, "ShipStaticData", {"TrueHeading": 360, "Sog": 102.3, "Cog": 360}, 5


def normalise_provider_json(docs: DataFrame, text: str) -> DataFrame:
    """docs with the common message shape in place of a provider's JSON; kind is null for documents of other kinds or no JSON.

    A report gives only the second of its minute: its time is the latest with that second, at most SKEW_S after it was
    received."""
    at = lambda path, kind: F.try_variant_get("v", path, kind)
    rows = docs.select(F.struct(*(c(x) for x in docs.columns)).alias("row"), F.try_parse_json(c(text)).alias("v")).withColumn("sort", at("$.MessageType", "string"))
    body = lambda path, kind: F.coalesce(*(at(f"$.Message.{k}.{path}", kind) for k in (*POSITION_KINDS, STATIC_KIND)))
    known = lambda path: F.when(body(path, "double") < UNKNOWN_FROM[path], body(path, "double"))
    blank = lambda path: F.nullif(F.trim(body(path, "string")), F.lit(""))
    zero = lambda path: F.nullif(body(path, "double"), F.lit(0.0))
    number = F.create_map(*(F.lit(x) for kv in POSITION_KINDS.items() for x in kv))[c("sort")]
    position, static = number.isNotNull(), c("sort") == STATIC_KIND
    heard = F.unix_timestamp(F.try_to_timestamp(F.substring(at("$.MetaData.time_utc", "string"), 1, 19)))
    second = body("Timestamp", "int")
    when = F.when(second.between(0, 59), heard - F.pmod(heard + SKEW_S - second, F.lit(60)) + SKEW_S).otherwise(heard)
    out = {
        "kind": F.when(position, "position").when(static, "static"),
        "msg_type": F.when(position, number).when(static, 5),
        "mmsi": body("UserID", "long"),
        "lat": F.when(position, body("Latitude", "double")),
        "lon": F.when(position, body("Longitude", "double")),
        "sog": F.when(position, known("Sog")),
        "cog": F.when(position, known("Cog")),
        "heading": F.when(position, known("TrueHeading")),
        "ts": F.when(position, when),
        "name": F.when(static, blank("Name")),
        "imo": F.when(static, zero("ImoNumber")).cast("long"),
        "to_bow": F.when(static, F.coalesce(body("Dimension.A", "int"), F.lit(0))),
        "draught": F.when(static, zero("MaximumStaticDraught")),
    }
    return rows.select(*(c("row").getField(x).alias(x) for x in docs.columns), *(e.alias(n) for n, e in out.items()))
