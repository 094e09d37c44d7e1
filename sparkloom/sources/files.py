"""File sources and sinks: contract CSV with rejected lines kept, files not seen before, pruned scans, atomic partition rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_contract_csv(spark: SparkSession, path: str, contract: StructType, names: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(typed rows under the contract's names, rejected lines with what could be read of them). names: header name for each contract name that differs."""
    header = StructType([StructField((names or {}).get(f.name, f.name), f.dataType) for f in contract] + [StructField("_rejected", StringType())])
    raw = spark.read.schema(header).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_rejected", enforceSchema=False).csv(path)
    typed = raw.filter(F.col("_rejected").isNull()).select(*(F.col((names or {}).get(f.name, f.name)).alias(f.name) for f in contract))
    return typed, raw.filter(F.col("_rejected").isNotNull()).withColumnRenamed("_rejected", "line")


def read_text_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """All columns as text; a short row's missing fields and absent columns are null."""
    raw = spark.read.options(header=True, inferSchema=False).csv(path)
    return raw.select(*((F.col(c) if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in columns))


def new_files_only(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(path, length) of files that the manifest doesn't have with that length; contents aren't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return listed.join(manifest.select("path", "length"), ["path", "length"], "left_anti")


def replace_partition(df: DataFrame, path: str, *keys: str) -> None:
    """Rewrites the partitions that df has and leaves the others; each is written by tasks of its own keys."""
    df.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def scan_partitions(spark: SparkSession, path: str, day: str, first: str, last: str, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """A range of days, with partition pruning and only the named columns read."""
    df = spark.read.option("mergeSchema", True).parquet(path).filter(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return (df if where is None else df.filter(where)).select(*columns)


def whole_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all files below a folder that aren't empty (Spark's reader skips those); each is read by the task
    that gets it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")


def file_set_manifest(files: DataFrame, classes: DataFrame, suffixes: Sequence[str], share: dict[str, float]) -> DataFrame:
    """(path, label, split, sha1, bytes, reason): what each of the files (path, content) is in a labelled set.

    The last folder is a file's class; classes: (class, label). Refused, first that applies: not_wanted (no such suffix),
    unknown_class, label_conflict:<class> (the name starts with another known class and _), empty, and duplicate_of:<path>
    (of equal contents the least path stays). The split goes by the name's hash, share: name to part of all, in order,
    the last takes the rest. Contents are hashed where they are read; only hashes travel."""
    c = F.col
    parts = F.split("path", "/")
    name, folder = F.element_at(parts, -1), F.when(F.size(parts) > 1, F.element_at(parts, -2))
    rows = files.select("path", name.alias("name"), folder.alias("class"), F.sha1("content").alias("sha1"), F.octet_length("content").cast("long").alias("bytes"), F.element_at(F.split(name, "_"), 1).alias("prefix"))
    known = classes.select("class", "label")
    rows = rows.join(known, "class", "left").join(known.select(c("class").alias("prefix"), F.lit(True).alias("named")), "prefix", "left")
    wanted = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).isin(list(suffixes))
    conflict = c("named") & (c("prefix") != c("class"))
    own = F.when(~wanted, "not_wanted").when(c("label").isNull(), "unknown_class").when(conflict, F.concat(F.lit("label_conflict:"), c("prefix"))).when(c("bytes") == 0, "empty")
    rows = rows.withColumn("reason", own)
    # one row for each content, combined before its shuffle; a hot content's rows meet a single fact
    first = rows.filter("reason is null").groupBy("sha1").agg(F.min("path").alias("first"), F.count(F.lit(1)).alias("copies"))
    told = rows.join(first.filter("copies > 1").select("sha1", "first"), "sha1", "left")
    reason = F.coalesce("reason", F.when(c("first") < c("path"), F.concat(F.lit("duplicate_of:"), c("first"))))
    draw = F.conv(F.substring(F.sha1("name"), 1, 8), 16, 10).cast("double") / 2**32
    bounds, low = [], 0.0
    for part, size in share.items():
        low += size
        bounds.append((part, low))
    split = F.lit(bounds[-1][0])
    for part, high in reversed(bounds[:-1]):
        split = F.when(draw < high, part).otherwise(split)
    return told.select("path", F.when(reason.isNull(), c("label")).alias("label"), F.when(reason.isNull(), split).alias("split"), "sha1", "bytes", reason.alias("reason"))
