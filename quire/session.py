"""A Spark session with the settings that the operators expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "quire", cpus: str | int = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, the submitted settings win."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("QUIRE_DRIVER_MEMORY", "12g"),
        "spark.driver.host": "127.0.0.1",
    } | extra
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    return builder.config(map=conf).getOrCreate()
