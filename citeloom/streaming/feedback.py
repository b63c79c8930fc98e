"""User decisions as they arrive: deduplicated events, windowed counts, and the latest state per pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.ids import blank_to_null

SCHEMA = "event_type string, left_id string, right_id string, accepted boolean, created_at timestamp"


def events(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_trigger: int = 100) -> DataFrame:
    """The Parquet files that land in a folder, as a stream; admission is bounded by files per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def cleaned(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Ids stripped, pairs unordered, repeats dropped as long as the watermark remembers them; events without ids or time left out."""
    x, y = blank_to_null(F.col("left_id")), blank_to_null(F.col("right_id"))
    e = stream.filter(x.isNotNull() & y.isNotNull() & F.col("created_at").isNotNull())
    e = e.select("event_type", F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "accepted", F.col("created_at").cast("timestamp").alias("created_at"))
    return e.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["event_type", "a", "b", "accepted", "created_at"])


def window_counts(stream: DataFrame, width: str = "30 days", slide: str | None = None) -> DataFrame:
    """(window_start, window_end, event_type, events, accepted) over tumbling or sliding windows of a cleaned stream."""
    w = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    g = stream.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.count_if("accepted").alias("accepted"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events", "accepted")


def session_counts(stream: DataFrame, gap: str = "1 day") -> DataFrame:
    """Bursts of decisions on one pair: sessions that end after ``gap`` without an event."""
    g = stream.groupBy(F.session_window("created_at", gap).alias("w"), "a", "b").agg(F.count(F.lit(1)).alias("events"))
    return g.select("a", "b", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def upsert_latest(batch: DataFrame, current: DataFrame | None) -> DataFrame:
    """The latest decision per type and pair of a micro-batch and what is known: for ``foreachBatch``, idempotent."""
    rows = batch.select("event_type", "a", "b", "accepted", "created_at")
    if current is not None:
        rows = rows.unionByName(current)
    return rows.groupBy("event_type", "a", "b").agg(F.max(F.struct("created_at", "accepted")).alias("m")).select("event_type", "a", "b", "m.accepted", "m.created_at")
