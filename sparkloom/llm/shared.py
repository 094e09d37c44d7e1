"""What the operators of this subpackage share: the shared folder, cut lineage, and the session's Python path."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one all executors share (spark.checkpoint.dir). Where that is unset, a local session gets
    a temporary folder; on a cluster executors would write where nobody reads, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault("dir", tempfile.mkdtemp(prefix="spark-sparkloom-"))
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, **options: str) -> DataFrame:
    """df as a written table: lineage ends here, and a lost executor costs only the tasks that read it."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch that goes to a Python worker: memory, not rows, is what a long text takes.
ARROW_BYTES = 4 << 20


def ready(spark: SparkSession) -> None:
    """Arrow batches are small, and Python workers started from another working directory find this package too."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    ready(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs as one, so that none can have the name of a helper column."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row")


def text_digest(text: str) -> Column:
    """16 bytes that name a text; a null counts as empty."""
    return F.unhex(F.substring(F.sha2(F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8"), 256), 1, 32))


#: A key with more than 1 / HOT of all rows is hot; there are fewer than HOT of them, whatever the input.
HOT = 1000


def dealt_join(rows: DataFrame, facts: DataFrame, on: str, size: str) -> DataFrame:
    """rows joined with facts, a written table with one row for each key that tells how many rows have it (size). Hot
    keys' facts, fewer than HOT rows, are broadcast, so their rows stay where they are; the others are shuffled."""
    total = facts.agg(F.sum(size)).first()[0] or 0
    hot = facts.filter(F.col(size) * HOT > total)
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(facts.filter(F.col(size) * HOT <= total).hint("merge"), on)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


#: Bits of a map of hashed keys; a few megabytes at most, whatever the input.
BITS = 1 << 25


def marked(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """rows with _marked: false where the key is surely none of the wanted ones, told on the map side by a broadcast
    bitmap of BITS hashed keys. Where it is true an exact join has to follow; a full map marks all rows."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS)) + 1
    maps = wanted.groupBy(F.bitmap_bucket_number(place(wanted_key)).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(wanted_key))).alias("_map"))
    at = rows.withColumn("_bucket", F.bitmap_bucket_number(place(key))).withColumn("_bit", F.bitmap_bit_position(place(key)))
    byte = F.conv(F.hex(F.expr("substring(_map, int(_bit div 8) + 1, 1)")), 16, 10).cast("int")
    held = at.join(F.broadcast(maps), "_bucket", "left")
    return held.withColumn("_marked", F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bit", "_map")
