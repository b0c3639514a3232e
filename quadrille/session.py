"""What a session needs before Python workers can import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers find the package where it is not installed; harmless where it is."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark
