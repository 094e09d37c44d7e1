"""Published runs: a table's versions side by side, one of them active, switched in one step.

Below a root: `runs/<id>` holds a run, whole once its _SUCCESS is there; `active.json` names the active run and the one
before it. A run is loaded first and named last, by a rename that replaces the file, so a reader that asks for the active
run gets a whole one, before or after the switch. Loading a run again is a no-op; a half-loaded one is written anew. The
active and the previous run are kept, for readers under way and for a rollback; older ones are deleted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def active(spark: SparkSession, root: str) -> dict[str, str | None]:
    """{"run", "previous"}: ids, None where there is none."""
    if not _fs(spark, root).exists(_path(spark, f"{root}/active.json")):
        return {"run": None, "previous": None}
    return json.loads(spark.read.text(f"{root}/active.json", wholetext=True).first()[0])


def _activate(spark: SparkSession, root: str, run: str, previous: str | None) -> None:
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(_fs(spark, root).getUri(), spark._jsc.hadoopConfiguration())
    held = _path(spark, f"{root}/.active-{uuid.uuid4().hex}")
    out = _fs(spark, root).create(held, True)
    out.write(bytearray(json.dumps({"run": run, "previous": previous}).encode()))
    out.close()
    kinds = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE
    context.rename(held, _path(spark, f"{root}/active.json"), how)


def publish_run(df: DataFrame, root: str, run: str) -> dict[str, object]:
    """Loads df as a run unless it is loaded, makes it the active one and deletes those before the previous."""
    spark, fs = df.sparkSession, _fs(df.sparkSession, root)
    loaded = not fs.exists(_path(spark, f"{root}/runs/{run}/_SUCCESS"))
    if loaded:
        df.write.mode("overwrite").parquet(f"{root}/runs/{run}")
    now = active(spark, root)
    switched = now["run"] != run
    if switched:
        _activate(spark, root, run, now["run"])
        now = {"run": run, "previous": now["run"]}
    pruned = [s.getPath().getName() for s in fs.listStatus(_path(spark, f"{root}/runs")) if s.getPath().getName() not in now.values()]
    for old in pruned:
        fs.delete(_path(spark, f"{root}/runs/{old}"), True)
    return {"run": run, "loaded": loaded, "activated": switched, "pruned": sorted(pruned)}


def rollback(spark: SparkSession, root: str) -> dict[str, str | None]:
    """Makes the previous run the active one; twice puts the newer back."""
    now = active(spark, root)
    if now["previous"] is None:
        raise ValueError("no previous run to go back to")
    _activate(spark, root, now["previous"], now["run"])
    return {"run": now["previous"], "previous": now["run"]}


def current(spark: SparkSession, root: str) -> DataFrame:
    run = active(spark, root)["run"]
    if run is None:
        raise ValueError("no run has been published")
    return spark.read.parquet(f"{root}/runs/{run}")
