"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings that decide results.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Runtime settings that decide plans. Joins carry no broadcast hint: a side is
# broadcast when its measured size is under the threshold, else both sides are
# shuffled and AQE splits the skewed partitions. Shuffled rows are compressed: 64 MB of
# them are half a GB in a task that sorts. A write by day keeps a few files open
# instead of sorting; a task that meets more days sorts the rest.
PLANNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    "spark.sql.maxConcurrentOutputFileWriters": "16",
    "spark.sql.parquet.compression.codec": "snappy",
}

# Static settings for a session of our own: expressions are built without
# recording the Python line each one comes from.
STARTUP = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in {**SEMANTICS, **PLANNING}.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str, master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` are further Spark settings."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**STARTUP, **SEMANTICS, **PLANNING, **extra}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def require_utc(spark: SparkSession) -> None:
    """Event days are UTC days; under another zone they would silently shift."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in {"UTC", "Etc/UTC", "Z", "GMT"}:
        raise ValueError(f"spark.sql.session.timeZone is {zone}; event days need UTC")
