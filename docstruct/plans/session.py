"""Session settings for tests and benchmarks on one machine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(
    cores: int = 8,
    memory: str = "12g",
    partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("docstruct")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC")
        .config("spark.ui.showConsoleProgress", "false")
        # Groups here are words of one pair: thousands of them fit the hash map of a task.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "10000")
        # Call sites for error messages cost more than building the plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in (conf or {}).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
