"""Filling fixed-capacity containers: best-fit decreasing over counted sizes.

Best fit needs the order of sizes, not the items: sizes are integers of at most
the capacity, so the whole corpus is a histogram of at most ``capacity`` rows.
Best-fit decreasing with a segment tree over the remaining capacities runs on
that histogram, a run of equal items into a run of equal containers at a time,
and gives exactly the containers that item-by-item best fit would.  Each document
then finds its container from its rank among the documents of its size, which
takes two-level counting and no global sort.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.staging import Stage

#: Groups among which the documents of one size are ranked; each is one task's work at most.
RANK_GROUPS = 1024


class RemainingTree:
    """Segment tree over remaining capacities 0..capacity: which of them have open containers."""

    def __init__(self, capacity: int):
        self.n = 1 << max(1, capacity + 1).bit_length()
        self.tree = np.zeros(2 * self.n, dtype=bool)

    def set(self, r: int, open_: bool) -> None:
        i = r + self.n
        self.tree[i] = open_
        i >>= 1
        while i:
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]
            i >>= 1

    def tightest(self, size: int) -> int:
        """The smallest remaining capacity >= size with an open container, or -1."""
        i = size + self.n
        if self.tree[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return -1


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (size, rank, items, container, per): items ``rank..rank+items-1`` of a size go to containers from
    ``container`` on, ``per`` in each.

    Sizes run from 1 to capacity.  The runs are as many as the size classes and the
    splits of container runs need, whatever the number of documents.
    """
    tree = RemainingTree(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}
    runs, containers = [], 0

    def put(left: int, start: int, count: int) -> None:
        if count and left:
            open_.setdefault(left, []).append((start, count))
            tree.set(left, True)

    for size in sorted(histogram, reverse=True):
        rank, n = 0, histogram[size]
        while n:
            left = tree.tightest(size)
            if left < 0:
                left, start, count = capacity, containers, -(-n // (capacity // size))
                containers += count
            else:
                start, count = open_[left].pop()
                if not open_[left]:
                    tree.set(left, False)
            per = left // size
            full = min(count, n // per)
            if full:
                runs.append((size, rank, full * per, start, per))
                put(left - per * size, start, full)
                rank, n = rank + full * per, n - full * per
            if full < count:
                if n:  # fewer than ``per`` are left: they share one container
                    runs.append((size, rank, n, start + full, n))
                    put(left - n * size, start + full, 1)
                    put(left, start + full + 1, count - full - 1)
                    n = 0
                else:
                    put(left, start + full, count - full)
    return runs


def pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece_no, piece_tokens): a document longer than the capacity in full pieces and a rest, others whole."""
    n = F.col("n_tokens")
    last = F.greatest(F.ceil(n / capacity).cast("int") - 1, F.lit(0))
    size = F.when(F.col("piece_no") < last, F.lit(capacity)).otherwise(n - last * capacity)
    return sized.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last))).select("doc_id", "piece_no", size.cast("long").alias("piece_tokens"))


def pack(sized: DataFrame, windows: list[tuple[str, int]], rank_groups: int = RANK_GROUPS) -> DataFrame:
    """(window_name, doc_id, piece_no, piece_tokens, container_no) for each window (name, capacity).

    ``sized`` holds one row per doc_id with n_tokens.  Containers are numbered from
    0.  A document without tokens takes no room and stands in container 0.  A null
    doc_id is a document like any other.
    """
    stage = Stage(sized.sparkSession, "packing")
    sized = stage.put(sized.select("doc_id", "n_tokens"))
    spark = sized.sparkSession
    out = None
    for name, capacity in windows:
        if capacity is None or capacity < 1:
            raise ValueError(f"window {name!r} has no capacity")
        cut = pieces(sized, capacity).withColumn("g", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(rank_groups)).cast("int"))
        filled = cut.filter("piece_tokens > 0")
        groups = stage.put(filled.groupBy("piece_tokens", "g").agg(F.count(F.lit(1)).alias("n")))
        histogram = {int(r[0]): int(r[1]) for r in groups.groupBy("piece_tokens").agg(F.sum("n")).collect()}  # capacity rows at most
        runs = best_fit_decreasing(histogram, capacity)
        before = F.sum("n").over(Window.partitionBy("piece_tokens").orderBy("g").rowsBetween(Window.unboundedPreceding, -1))
        offsets = groups.select("piece_tokens", "g", F.coalesce(before, F.lit(0)).alias("before"))
        own = F.row_number().over(Window.partitionBy("piece_tokens", "g").orderBy("doc_id", "piece_no")) - 1
        ranked = filled.withColumn("own", own).join(offsets, ["piece_tokens", "g"]).withColumn("rank", F.col("before") + F.col("own"))
        table = spark.createDataFrame(runs or [(0, 0, 0, 0, 1)], "piece_tokens long, first long, items long, container long, per long")
        # the runs of a size as one row, which a document of that size reads through for its own: sizes that many documents share have few runs,
        # because equal items fill equal containers a run at a time
        table = table.groupBy("piece_tokens").agg(F.array_sort(F.collect_list(F.struct("first", "items", "container", "per"))).alias("runs"))
        run = F.element_at(F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["first"] + r["items"])), 1)
        placed = ranked.join(F.broadcast(table), "piece_tokens").withColumn("r", run)  # a row per size: capacity rows at most
        placed = placed.select("doc_id", "piece_no", "piece_tokens", (F.col("r.container") + F.floor((F.col("rank") - F.col("r.first")) / F.col("r.per"))).cast("long").alias("container_no"))
        placed = placed.unionByName(cut.filter("piece_tokens = 0").select("doc_id", "piece_no", "piece_tokens", F.lit(0).cast("long").alias("container_no")))
        placed = placed.select(F.lit(name).alias("window_name"), "*")
        out = placed if out is None else out.unionByName(placed)
    return out
