"""The log of user decisions: latest state and counts over time. The streaming twin is in ``citeloom.streaming``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.ids import blank_to_null, strip_ws


def latest(events: DataFrame) -> DataFrame:
    """(event_type, a, b, accepted, decided_at, events): the newest decision per type and unordered pair of ids.

    Null times are oldest; at one time accepted counts before refused and both
    before undecided.  Pairs with a null or blank id are left out.
    """
    x, y = blank_to_null(F.col("left_id")), blank_to_null(F.col("right_id"))
    e = events.filter(x.isNotNull() & y.isNotNull()).select("event_type", F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), "created_at", "accepted")
    g = e.groupBy("event_type", "a", "b").agg(F.max(F.struct("created_at", "accepted")).alias("m"), F.count(F.lit(1)).alias("events"))
    return g.select("event_type", "a", "b", "m.accepted", F.date_format("m.created_at", "yyyy-MM-dd HH:mm:ss").alias("decided_at"), "events")


def window_counts(events: DataFrame, width: str) -> DataFrame:
    """(window_start, event_type, events, accepted): distinct events per tumbling window; events without a time left out."""
    e = events.filter("created_at is not null").select("event_type", strip_ws(F.col("left_id")).alias("l"), strip_ws(F.col("right_id")).alias("r"), "accepted", "created_at").distinct()
    g = e.groupBy(F.window("created_at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.count_if("accepted").alias("accepted"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "events", "accepted")
