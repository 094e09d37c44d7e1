"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str) -> DataFrame:
    """A stream over Parquet files whose schema is that of the files there now; timestamps carry a zone, as watermarks need it."""
    schema = spark.read.parquet(path).schema
    out = spark.readStream.schema(schema).parquet(path if not path.endswith("t") else f"{path[:-1]}[t]")
    return out.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def dedupe(events: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Redelivery within the watermark's delay is a no-op; state is dropped behind it."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def counters(events: DataFrame, ts: str, kind: str, every: str, delay: str) -> DataFrame:
    """Events of each kind in tumbling windows; a window is given out once it is complete."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, every).alias("span"), kind).agg(F.count(F.lit(1)).alias("n"))


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Runs the stream over all that is there now and gives its result as a table in the folder."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
