"""One stream of JSON records to three tables: positions, statics and dead letters, each record in exactly one of them.

`classified` judges a record by its topic, its envelope (source, received_at) and the rules of its kind, and casts what a
table takes with forms that give null instead of an error; a value that passes its rule and is refused by the table's
type is a dead letter of its own reason. So no record can end the batch, and one poisoned record costs only itself.
`Landing.absorb` is for foreachBatch: each table has the batch's number as a partition, which a batch that is tried again
replaces, so every record lands once. Positions that were stored before, by (mmsi, ts), are counted as duplicates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.validation import first_failure
from ..sources.files import replace_partition
from ..sources.scratch import scratch

c = F.col
#: The vessel numbers, message kinds of positions, and legal ranges of optional fields (top, whole).
VESSELS, MESSAGES, FUTURE_S = (200_000_000, 799_999_999), (1, 2, 3, 18, 19, 27), 120.0
OPTIONAL = {"sog": (102.2, False), "cog": (359.9, False), "heading": (359, True), "nav_status": (15, True)}
LAST_TS = 253_402_300_799.0
POSITION = "mmsi long, ts timestamp, lat double, lon double, sog float, cog float, heading int, nav_status int, msg_type int, received_at timestamp"
NUMBERS, WHOLE = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", r"^BIGINT$"


FIELDS = ("source", "received_at", "mmsi", "lat", "lon", *OPTIONAL, "ts", "msg_type", "cid", "reason")


def _field(name: str) -> tuple[Column, Column, Column]:
    """(the field's JSON type, whether it is given and not null, its value as a double), of `_fields`."""
    return c(f"_kind_{name}"), c(f"_kind_{name}").isNotNull() & (c(f"_kind_{name}") != "VOID"), c(f"_value_{name}")


def _fields(rows: DataFrame) -> DataFrame:
    """rows with each field's type and value as columns, so that the rules look a field up once and not once each."""
    kinds = {f"_kind_{n}": F.schema_of_variant(F.try_variant_get("v", f"$.{n}", "variant")) for n in FIELDS}
    values = {f"_value_{n}": F.try_variant_get("v", f"$.{n}", "double") for n in FIELDS if n not in ("source", "cid", "reason")}
    return rows.withColumns(kinds | values | {"_whole": F.schema_of_variant("v")})


def classified(records: DataFrame, topic: str, body: str, now: Column) -> DataFrame:
    """records with kind (position, static, dead or reject), reason (null but for dead letters), and v, the parsed body."""
    rows = _fields(records.withColumn("v", F.try_parse_json(c(body))))
    number = lambda n: F.coalesce(_field(n)[0].rlike(NUMBERS), F.lit(False))
    whole = lambda n: F.coalesce(_field(n)[0].rlike(WHOLE), F.lit(False))
    text = lambda n: F.coalesce(_field(n)[0] == "STRING", F.lit(False))
    value = lambda n: _field(n)[2]
    an_object = F.coalesce(c("_whole").startswith("OBJECT"), F.lit(False))
    envelope = [("unparseable_record", ~an_object), ("missing_envelope", ~(text("source") & number("received_at")))]
    vessel = ("non_vessel_mmsi", ~(whole("mmsi") & F.coalesce(value("mmsi").between(*VESSELS), F.lit(False))))
    refused = ("sink_refuses_received_at", ~value("received_at").between(0, LAST_TS))
    optional = []
    for name, (top, must_be_whole) in OPTIONAL.items():
        fine = (whole if must_be_whole else number)(name) & F.coalesce(value(name).between(0, top), F.lit(False))
        optional.append((f"{name}_out_of_range", _field(name)[1] & ~fine))
    position = [
        *envelope,
        vessel,
        ("missing_position", ~(number("lat") & number("lon"))),
        ("position_unavailable", (value("lat") == 91) | (value("lon") == 181)),
        ("position_out_of_range", ~(value("lat").between(-90, 90) & value("lon").between(-180, 180))),
        ("null_island", (F.abs(value("lat")) < 0.001) & (F.abs(value("lon")) < 0.001)),
        *optional,
        ("missing_timestamp", ~number("ts") | (value("ts") < 0)),
        ("timestamp_in_future", value("ts") > now + FUTURE_S),
        ("bad_msg_type", ~F.coalesce(value("msg_type").isin(*MESSAGES), F.lit(False))),
        refused,
    ]
    letter = ("malformed_dead_letter", ~(an_object & text("cid") & text("reason") & F.coalesce(F.try_variant_get("v", "$.stage", "string").isin("decode", "validate", "sink"), F.lit(False))))
    static, dead = c(topic) == "static", c(topic) == "dead"
    own = F.coalesce(first_failure([letter]), F.try_variant_get("v", "$.reason", "string"))
    reason = F.when(dead, own).when(static, first_failure([*envelope, vessel, refused])).when(c(topic) == "position", first_failure(position)).otherwise("unknown_topic")
    kind = F.when(dead, "dead").when(reason.isNotNull(), "reject").when(static, "static").otherwise("position")
    told = rows.withColumn("reason", reason).withColumn("kind", kind)
    return told.select(*records.columns, "v", "reason", "kind")


def typed(rows: DataFrame, schema: str, *kept: str) -> DataFrame:
    """cid, the fields of a flat schema from v, null where a value has another type, and columns of rows."""
    out = []
    for f in StructType.fromDDL(schema):
        number = F.try_variant_get("v", f"$.{f.name}", "double" if f.dataType.typeName() == "timestamp" else f.dataType.simpleString())
        out.append((F.timestamp_micros((number * 1e6).try_cast("long")) if f.dataType.typeName() == "timestamp" else number).alias(f.name))
    return rows.select("cid", *out, *kept)


class Landing:
    """The tables below `folder`. Records have topic, body and cid, a name of their own."""

    def __init__(self, spark: SparkSession, folder: str, now: Column | None = None):
        self.spark, self.folder, self.now = spark, folder, now
        self.schemas = {
            "positions": f"cid string, {POSITION}, day date, batch long",
            "statics": "cid string, mmsi long, received_at timestamp, body string, batch long",
            "dead": "cid string, topic string, reason string, body string, batch long",
            "batches": "records long, positions long, duplicates long, statics long, dead long, batch long",
        }
        for name, schema in self.schemas.items():
            spark.createDataFrame([], schema).write.mode("append").parquet(f"{folder}/{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}")

    def _put(self, df: DataFrame, name: str, *keys: str) -> None:
        if keys == ("batch",):
            # one key holds the whole batch: written by the tasks that have it
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.folder}/{name}")
        else:
            replace_partition(df, f"{self.folder}/{name}", *keys)

    def absorb(self, records: DataFrame, batch_id: int) -> None:
        now = F.unix_micros(F.current_timestamp()) / 1e6 if self.now is None else self.now
        path, number = scratch(self.spark), F.lit(batch_id).cast("long")
        classified(records.select("topic", "body", "cid"), "topic", "body", now).drop("v").write.parquet(path)
        rows = self.spark.read.parquet(path).withColumn("v", F.try_parse_json("body"))
        found = typed(rows.filter("kind = 'position'"), POSITION)
        first = found.groupBy("mmsi", "ts").agg(F.min_by(F.struct(*(x for x in found.columns if x not in ("mmsi", "ts"))), "cid").alias("x")).select("mmsi", "ts", "x.*")
        first = first.withColumn("day", F.to_date("ts"))
        # only the days of this batch are read of what is stored
        stored = self.table("positions").filter(c("batch") != batch_id).join(first.select("day").distinct(), "day", "left_semi")
        fresh = first.join(stored.select("mmsi", "ts"), ["mmsi", "ts"], "left_anti")
        names = [x.split()[0] for x in self.schemas["positions"].split(", ")]
        self._put(fresh.withColumn("batch", number).select(*names), "positions", "day", "batch")
        self._put(typed(rows.filter("kind = 'static'"), "mmsi long, received_at timestamp", "body").withColumn("batch", number), "statics", "batch")
        self._put(rows.filter("kind in ('dead', 'reject')").select("cid", "topic", "reason", "body", number.alias("batch")), "dead", "batch")
        count = lambda k: F.count_if(c("kind").isin(*k))
        new = self.table("positions").filter(c("batch") == batch_id).agg(F.count(F.lit(1)).alias("positions"))
        told = rows.agg(F.count(F.lit(1)).alias("records"), count(["position"]).alias("found"), count(["static"]).alias("statics"), count(["dead", "reject"]).alias("dead"))
        told = told.join(new, F.lit(True), "full").select("records", "positions", (c("found") - c("positions")).alias("duplicates"), "statics", "dead", number.alias("batch"))
        self._put(told, "batches", "batch")


def land(records: DataFrame, folder: str, now: Column | None = None) -> Landing:
    """Lands a stream until it is drained; a second call on the same folder goes on where the first one ended."""
    landing = Landing(records.sparkSession, folder, now)
    job = records.writeStream.foreachBatch(landing.absorb).option("checkpointLocation", f"{folder}/job").trigger(availableNow=True).start()
    job.awaitTermination()
    return landing
