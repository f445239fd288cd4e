"""Session helpers: a configured session, and workers that can import the package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> SparkSession:
    """Python workers find the package next to this file; on a cluster without it, ship it with --py-files."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benchmarks."""
    conf = {
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").appName("siltstone").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return importable(spark)
