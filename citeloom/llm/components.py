"""Consolidating pairwise matches into groups: alternating large-star and small-star.

Decisions on pairs become edges; ``operators.stars`` rewrites them through salted
joins until nothing changes; then every record hangs on the smallest identifier of
its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.ids import blank_to_null
from citeloom.operators.skew import HOT_ROWS
from citeloom.operators.stars import contracted


def accepted_links(feedback: DataFrame, audits: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs that the audits merged or whose latest merge_hint is accepted.

    Ids are stripped; null and blank ids and pairs of an id with itself link
    nothing.  The latest hint counts by ``created_at`` (null is oldest) in either
    order of ids; at one time an accepted hint counts before a refused one, and
    both before an undecided one.  Null and empty arrays of pairs give no rows.
    """
    hints = _pairs(feedback.filter(F.lower(F.trim("event_type")) == "merge_hint"), "accepted", "created_at")
    latest = hints.groupBy("a", "b").agg(F.max(F.struct("created_at", "accepted")).alias("last")).filter("last.accepted").select("a", "b")
    merged = _pairs(audits.select(F.explode("merged_pairs").alias("p")).select("p.left_id", "p.right_id"))
    return latest.unionByName(merged).distinct()


def _pairs(df: DataFrame, *more: str) -> DataFrame:
    x, y = blank_to_null(F.col("left_id")), blank_to_null(F.col("right_id"))
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), x.isNotNull().alias("x"), y.isNotNull().alias("y"), *more).filter("x and y and a < b").drop("x", "y")


def connected_components(links: DataFrame, max_rounds: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group_id, record_id) of all ids in ``links`` (a, b with a <> b); group_id is the smallest id of the component.

    Repeated and reversed links are fine; an empty input gives an empty result.
    Raises if ``max_rounds`` do not suffice, which takes far more than any data can.
    """
    edges = contracted(links, max_rounds, hot_rows)
    return edges.select(F.col("small").alias("group_id"), F.col("big").alias("record_id")).unionByName(edges.select(F.col("small").alias("group_id"), F.col("small").alias("record_id")).distinct())
