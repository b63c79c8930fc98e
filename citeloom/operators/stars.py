"""Contracting a graph to stars: alternating large-star and small-star rewrites through distributed joins.

Every round moves edges to smaller neighbours until nothing changes; then every
node hangs on the smallest of its component.  Rounds grow with the logarithm of
the longest chain.  Stars grow hot centres by design, so the joins salt every node
whose degree passes a bound.  Rounds are written to the shared folder; two rounds
are kept at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.skew import HOT_ROWS, salted_join
from citeloom.staging import Stage


def _spread(edges: DataFrame, mins: DataFrame, key: str, spread: str, hot_rows: int, total: int | None) -> DataFrame:
    """``edges`` with the ``m`` of their ``key``; no node of a graph of at most ``hot_rows`` edges can be hot, so nothing is salted there."""
    if total is not None and total <= hot_rows:
        return edges.join(mins.select(key, "m"), key)
    return salted_join(edges, mins.select(key, "m"), key, "inner", spread=spread, hot_rows=hot_rows, counts=mins.select(key, "n"))


def large_star(edges: DataFrame, hot_rows: int = HOT_ROWS, total: int | None = None) -> DataFrame:
    """(big, small) edges with every larger neighbour of a node moved to the node's smallest one; ``total`` edges, if known."""
    ends = edges.select(F.col("small").alias("u"), F.col("big").alias("v")).unionByName(edges.select(F.col("big").alias("u"), F.col("small").alias("v")))
    mins = ends.groupBy("u").agg(F.min("v").alias("v"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("small"), F.least("u", "v").alias("m"), "n")
    out = _spread(edges, mins, "small", "big", hot_rows, total)
    return out.select("big", F.col("m").alias("small")).distinct()


def small_star(edges: DataFrame, hot_rows: int = HOT_ROWS, total: int | None = None) -> DataFrame:
    """(big, small) edges with every smaller neighbour of a node, and the node, moved to the smallest one; ``total`` edges, if known."""
    mins = edges.groupBy("big").agg(F.min("small").alias("m"), F.count(F.lit(1)).alias("n"))
    out = _spread(edges, mins, "big", "small", hot_rows, total)
    moved = out.filter("small > m").select(F.col("small").alias("big"), F.col("m").alias("small"))
    return moved.unionByName(mins.select("big", F.col("m").alias("small"))).distinct()


def contracted(links: DataFrame, max_rounds: int = 60, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(big, small): every linked id but the smallest of its component, with that smallest one.

    ``links`` are (a, b); repeated and reversed links are fine, an id linked to itself
    links nothing, an empty input gives an empty result.  The end is told by the edge
    set's count, sum and exclusive or of 64-bit digests staying the same: two different
    sets agree in all three with a chance of about one in 2**64.  Raises if
    ``max_rounds`` do not suffice, which takes far more than any data can.
    """
    stage = Stage(links.sparkSession, "stars")
    edges = stage.put(links.select(F.greatest("a", "b").alias("big"), F.least("a", "b").alias("small")).filter("big > small").distinct())
    mark = _mark(edges)
    for _ in range(max_rounds):
        # neither rewrite makes more edges than there are
        wide = stage.put(large_star(edges, hot_rows, mark[0]))
        nxt = stage.put(small_star(wide, hot_rows, mark[0]))
        stage.drop(wide, edges)
        edges, before, mark = nxt, mark, _mark(nxt)
        if mark == before:
            return edges
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free digests of an edge set."""
    h = F.xxhash64("big", "small")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())
