"""Silences found while reports stream in: derived events that later reports may change or take back.

Each batch of reports is kept once (its own partitions, so a batch that comes again replaces itself), then one pass of
`operators.tracks` runs over the lookback window, read by pruning days. The pass upserts its silences by (thing,
silent_from) into a table partitioned by day: new ones are added, known ones keep the batch that found them first, and
those that the reports no longer support (late data has filled the gap) stay as withdrawn rows, so that a reader of
changes learns of it. What is older than the window is left as it is. Only days with a change are rewritten, each in one
step, so the pass can run at any time, any number of times, and a batch that is tried again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, LongType, StructType

from ..operators import tracks as T
from ..sources.files import replace_partition
from ..sources.scratch import scratch

c = F.col
REPORT = ("thing", "ts", "lat", "lon", "knots", "course")
FACTS = ("silent_to", "seconds", "metres", "knots", "reception_from", "reception_to", "n_near", "verdict", "impossible", "score", "reasons")


class Detector:
    """The tables below `folder` and the pass over them. reports: a table or stream with REPORT's columns."""

    def __init__(self, reports: DataFrame, folder: str, rules: T.Rules):
        self.spark: SparkSession = reports.sparkSession
        self.folder, self.rules = folder, rules
        self.kept = StructType(list(reports.select(*REPORT).schema)).add("day", DateType()).add("batch", LongType())
        at = self.spark.createDataFrame([], StructType(list(reports.select(*REPORT).schema)))
        now = T.newest(at)
        judged = T.assess(at, T.reception_grid(at, now, rules), now, rules)
        self.found = StructType(list(judged.schema)).add("withdrawn", BooleanType()).add("first_batch", LongType()).add("changed_batch", LongType()).add("day", DateType())
        for name, schema in (("positions", self.kept), ("silences", self.found)):
            self.spark.createDataFrame([], schema).write.mode("append").parquet(f"{folder}/{name}")

    def positions(self) -> DataFrame:
        return self.spark.read.schema(self.kept).parquet(f"{self.folder}/positions")

    def silences(self, withdrawn: bool = False) -> DataFrame:
        """The silences as of the last pass, those taken back too if asked for."""
        found = self.spark.read.schema(self.found).parquet(f"{self.folder}/silences")
        return found if withdrawn else found.filter("not withdrawn")

    def absorb(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: keeps the batch's reports and runs a pass."""
        rows = batch.select(*REPORT).filter("ts is not null").withColumns({"day": F.to_date("ts"), "batch": F.lit(batch_id).cast("long")})
        replace_partition(rows, f"{self.folder}/positions", "day", "batch")
        self.detect(batch_id)

    def detect(self, batch_id: int) -> None:
        last = self.positions().agg(F.max("day")).first()[0]
        if last is None:
            return
        now = T.newest(self.positions().filter(c("day") == F.lit(last)))
        since = self.spark.range(1).select(T.since(now, self.rules).alias("t")).first()[0]
        since = F.lit(str(since)).cast(self.kept["ts"].dataType)
        # the grid's whole hours begin up to an hour before the lookback
        early = since - F.expr("INTERVAL 1 HOUR")
        window = self.positions().filter((c("day") >= F.to_date(early)) & (c("ts") >= early))
        at = T.positions(window, *REPORT)
        seen = T.assess(at, T.reception_grid(at, now, self.rules), now, self.rules)
        known = self.silences(withdrawn=True).filter(c("day") >= F.to_date(since))
        before = known.filter(c("silent_from") >= since)
        side = lambda df, name: df.select(*T.KEYS, F.struct(*(x for x in df.columns if x not in T.KEYS)).alias(name))
        both = side(seen, "new").join(side(before, "old"), T.KEYS, "full")
        same = c("new").isNotNull() & c("old").isNotNull() & ~c("old.withdrawn")
        for f in FACTS:
            same = same & c(f"new.{f}").eqNullSafe(c(f"old.{f}"))
        gone = c("new").isNull()
        same = F.coalesce(same | (gone & c("old.withdrawn")), F.lit(False))
        now_rows = both.select(
            *T.KEYS,
            *(F.when(gone, c(f"old.{f}")).otherwise(c(f"new.{f}")).alias(f) for f in FACTS),
            gone.alias("withdrawn"),
            F.coalesce("old.first_batch", F.lit(batch_id)).cast("long").alias("first_batch"),
            F.when(same, c("old.changed_batch")).otherwise(F.lit(batch_id)).cast("long").alias("changed_batch"),
            F.to_date("silent_from").alias("day"),
            same.alias("same"),
        )
        path = scratch(self.spark)
        now_rows.unionByName(known.filter(c("silent_from") < since).withColumn("same", F.lit(True))).write.parquet(path)
        rows = self.spark.read.parquet(path)
        days = rows.filter("not same").select("day").distinct()
        replace_partition(rows.join(days, "day", "left_semi").select(*(f.name for f in self.found)), f"{self.folder}/silences", "day")


def follow(reports: DataFrame, folder: str, rules: T.Rules) -> DataFrame:
    """Absorbs a stream of reports (REPORT's columns) until it is drained; the silences then, withdrawn ones too. A
    second call on the same folder goes on where the first one ended."""
    detector = Detector(reports, folder, rules)
    job = reports.writeStream.foreachBatch(detector.absorb).option("checkpointLocation", f"{folder}/job").trigger(availableNow=True).start()
    job.awaitTermination()
    return detector.silences(withdrawn=True)
