"""Items that appear together: heavy-light counting of pairs, and their lift.

Items are split by frequency.  Pairs of frequent (heavy) items are counted by
popcounts over bit rows, one block of baskets at a time; pairs of rare (light)
items by hashing the pairs within a basket, which a light item enters seldom by
definition; mixed pairs by probing the basket's heavy list from each light item.
The three are united and scored.

What cannot reach the thresholds is left out before any pair is made, exactly:
n(a,b) >= min_count needs n(a), n(b) >= min_count, and n(a,b) * N >= lift * n(a)
* n(b) with n(a,b) <= min(n(a), n(b)) needs max(n(a), n(b)) <= N / lift.  An item
that a third of all baskets hold is therefore no load at the usual lift.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.ids import bare_id
from citeloom.staging import Stage

#: Heavy items at most: bounds the bit matrix to HEAVY_ITEMS * BLOCK_BASKETS / 8 bytes (32 MB).
HEAVY_ITEMS = 1024
#: An item in fewer baskets than this is light even where fewer than HEAVY_ITEMS items are heavy.
HEAVY_FROM = 64
#: Baskets of one block.
BLOCK_BASKETS = 262_144
#: Light items of one basket whose pairs one task makes with all of the basket; longer baskets are split.
LONG_BASKET = 1_000


def baskets_of_references(papers: DataFrame) -> DataFrame:
    """(basket, item), distinct: the bare identifiers in each canonical_id's references; null and blank are none."""
    return papers.select(F.col("canonical_id").alias("basket"), F.explode(F.array_distinct(F.transform("references", bare_id))).alias("item")).filter("item is not null and basket is not null").distinct()


def popcounts(rows: pd.DataFrame, heavy: int) -> pd.DataFrame:
    """(x, y, n), x < y: baskets that hold both heavy items; rows are (basket, h) of one block."""
    basket, _ = pd.factorize(rows["basket"])
    h = rows["h"].to_numpy()
    present, at = np.unique(h, return_inverse=True)
    bits = np.zeros((len(present), (int(basket.max()) // 64 + 1) * 8 if len(basket) else 8), dtype=np.uint8)
    np.bitwise_or.at(bits, (at, basket >> 3), (1 << (basket & 7)).astype(np.uint8))
    words = bits.view(np.uint64)
    out = []
    for i in range(len(present) - 1):
        n = np.bitwise_count(words[i] & words[i + 1 :]).sum(axis=1, dtype=np.int64)
        j = np.nonzero(n)[0]
        if len(j):
            out.append(pd.DataFrame({"x": present[i], "y": present[i + 1 + j], "n": n[j]}))
    return pd.concat(out) if out else pd.DataFrame({"x": [], "y": [], "n": []}).astype({"x": "int32", "y": "int32", "n": "int64"})


def light_pairs(light: DataFrame, stage: Stage, long_basket: int = LONG_BASKET) -> DataFrame:
    """(item_a, item_b), a < b: the pairs of the light items of every basket.

    The square of a basket of more than ``long_basket`` items is cut into strips: each
    task pairs ``long_basket`` of its items, about, with all of them.
    """
    sizes = light.groupBy("basket").agg(F.count(F.lit(1)).alias("n"))
    long = stage.put(sizes.filter(F.col("n") > long_basket).select("basket", F.ceil(F.col("n") / long_basket).cast("int").alias("parts")))
    a, b = light.withColumnRenamed("item", "item_a"), light.withColumnRenamed("item", "item_b")
    if long.isEmpty():
        return a.join(b, "basket").filter("item_a < item_b").select("item_a", "item_b")
    short = lambda x: x.join(long, "basket", "left_anti")
    strips = a.join(long, "basket").withColumn("part", F.pmod(F.xxhash64("item_a"), F.col("parts")).cast("int"))
    whole = b.join(long, "basket").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = strips.select("basket", "part", "item_a").join(whole.select("basket", "part", "item_b"), ["basket", "part"])
    return short(a).join(short(b), "basket").select("item_a", "item_b").unionByName(cut.select("item_a", "item_b")).filter("item_a < item_b")


def pair_counts(baskets: DataFrame, total: int, min_count: int = 5, lift: float = 8.0, heavy_items: int = HEAVY_ITEMS, heavy_from: int = HEAVY_FROM, block_baskets: int = BLOCK_BASKETS, long_basket: int = LONG_BASKET) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab), a < b: pairs with n_ab >= min_count that may reach ``lift``.

    ``baskets`` holds distinct (basket, item); ``total`` is the number of baskets,
    those without items included.
    """
    stage = Stage(baskets.sparkSession, "cooccurrence")
    baskets = stage.put(baskets)
    counts = baskets.groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= min_count) & (F.col("n") * F.lit(lift) <= F.lit(total)))
    counts = stage.put(counts)
    heavy = counts.filter(F.col("n") >= heavy_from).orderBy(F.desc("n"), "item").limit(heavy_items)
    ranks = heavy.select("item").collect()  # HEAVY_ITEMS rows at most
    heavy = baskets.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(ranks)], "item string, h int")
    kept = counts.join(F.broadcast(heavy), "item", "left").select("item", "h")
    kept = stage.put(baskets.join(kept, "item").select("basket", "item", "h"))

    light = kept.filter("h is null").select("basket", "item")
    ll = light_pairs(light, stage, long_basket).groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_ab"))

    lists = kept.filter("h is not null").groupBy("basket").agg(F.collect_list("item").alias("heavies"))  # HEAVY_ITEMS at most
    hl = light.join(lists, "basket").select("item", F.explode("heavies").alias("other"))
    hl = hl.groupBy(F.least("item", "other").alias("item_a"), F.greatest("item", "other").alias("item_b")).agg(F.count(F.lit(1)).alias("n_ab"))

    blocks = max(baskets.sparkSession.sparkContext.defaultParallelism, -(-total // block_baskets))
    hh = (
        kept.filter("h is not null")
        .select(F.pmod(F.xxhash64("basket"), F.lit(blocks)).cast("int").alias("block"), F.xxhash64("basket").alias("basket"), "h")
        .groupBy("block")
        .applyInPandas(lambda pdf: popcounts(pdf, heavy_items), "x int, y int, n long")
        .groupBy("x", "y")
        .agg(F.sum("n").alias("n_ab"))
    )
    names = F.broadcast(heavy)
    hh = hh.join(names.select(F.col("h").alias("x"), F.col("item").alias("i")), "x").join(names.select(F.col("h").alias("y"), F.col("item").alias("j")), "y")
    hh = hh.select(F.least("i", "j").alias("item_a"), F.greatest("i", "j").alias("item_b"), "n_ab")

    pairs = ll.unionByName(hl).unionByName(hh).filter(F.col("n_ab") >= min_count)
    na, nb = counts.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), counts.select(F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    return pairs.join(na, "item_a").join(nb, "item_b").select("item_a", "item_b", "n_a", "n_b", "n_ab")


def lifted_pairs(papers: DataFrame, min_count: int = 5, lift: int = 8, **sizes) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, lift) of the pairs of references with n_ab >= min_count and lift >= ``lift``."""
    total = papers.select("canonical_id").filter("canonical_id is not null").distinct().count()
    pairs = pair_counts(baskets_of_references(papers), total, min_count, lift, **sizes)
    seen = F.col("n_ab") * F.lit(total)
    return pairs.filter(seen >= F.lit(lift) * F.col("n_a") * F.col("n_b")).withColumn("lift", seen / (F.col("n_a") * F.col("n_b")))
