"""Session settings the engine wants; everything else is left to the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def builder(app: str = "weft", master: str | None = None) -> SparkSession.Builder:
    """AQE with skew handling, UTC, and the cost-based optimizer's statistics."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return b.master(master) if master else b


def local(cpus: int = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        builder(master=f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
