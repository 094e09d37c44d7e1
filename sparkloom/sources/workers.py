"""Python workers that find this package, whatever the working directory they were started from."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession | None = None) -> None:
    """Adds the package's folder to the path of workers that the session starts from now on."""
    spark = spark or SparkSession.active()
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
