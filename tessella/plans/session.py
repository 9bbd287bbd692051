"""A session with the settings the engine counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def make_session(name: str = "tessella", master: str | None = None, warehouse: str | None = None, shuffle: int = 8) -> SparkSession:
    """UTC, ANSI, adaptive execution; no query of files by path from SQL text."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    if warehouse:
        b = b.config("spark.sql.warehouse.dir", warehouse)
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.runSQLOnFiles", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
