"""The session that tests and the bench use; on a cluster the given one is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "8g", scratch: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if scratch:
        builder = builder.config("spark.local.dir", scratch).config("spark.checkpoint.dir", f"{scratch}/shared").config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
    return builder.getOrCreate()
