"""A folder for a query's own tables: below spark.checkpoint.dir, which all executors share; a temporary one only in a local
session where that is unset."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="spark-sparkloom-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
