"""Session defaults for local runs; on a cluster the submitted configuration wins."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that every plan in this package assumes.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A single-JVM session with one shuffle partition a core."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trellis")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config(map=DEFAULTS)
        .getOrCreate()
    )
