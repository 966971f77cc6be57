"""Spark session settings shared by the tests and the bench."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, driver_memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine; a cluster brings its own master, memory and checkpoint folder."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("spotweave").config("spark.driver.memory", driver_memory)
    for key, value in (SETTINGS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
