"""The session settings that results depend on, and those that plans profit from."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC days; adaptive plans that split skewed joins and merge small partitions; columns that queries need at the scan.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session on this machine; on a cluster the settings come from its own configuration."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory).config(map=SETTINGS)
    spark = builder.config("spark.sql.shuffle.partitions", str(partitions or cpus)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
