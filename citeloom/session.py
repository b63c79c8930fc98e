"""Session settings that hold from a laptop to a large cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results or survive any scale; sizes (memory, cores, shuffle partitions) stay the caller's.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, memory: str = "8g", shuffle_partitions: int | None = None, name: str = "citeloom") -> SparkSession:
    """A local session for tests and benches."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for k, v in ENGINE_CONF.items():
        b = b.config(k, v)
    return (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
