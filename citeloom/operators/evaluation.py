"""Offline quality of ranked results, for many queries at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_metrics(ranked: DataFrame, relevant: DataFrame, key: str = "query_id", item: str = "item") -> DataFrame:
    """(key, p_at_5, reciprocal_rank, recall_at_10) of ranked (key, item, rank) against relevant (key, item).

    Queries without relevant items have recall 0, queries without results no row.
    """
    rel = relevant.select(key, item).distinct().withColumn("_rel", F.lit(1))
    r = ranked.join(rel, [key, item], "left")
    hit = F.coalesce("_rel", F.lit(0))
    m = r.groupBy(key).agg(
        F.sum(F.when(F.col("rank") <= 5, hit).otherwise(0)).alias("h5"),
        F.least(F.lit(5), F.max("rank")).alias("n5"),
        F.min(F.when(hit == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= 10, hit).otherwise(0)).alias("h10"),
    )
    total = rel.groupBy(key).agg(F.count(F.lit(1)).alias("t"))
    return m.join(total, key, "left").select(key, (F.col("h5") / F.col("n5")).alias("p_at_5"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.col("h10") / F.col("t"), F.lit(0.0)).alias("recall_at_10"))


def entropy_of_sizes(groups: DataFrame, key: str, value: str) -> DataFrame:
    """(key, groups, balance): the entropy of group sizes over its maximum; 0.5 for a single group."""
    s = groups.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    t = s.groupBy(key).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    p = F.col("n") / F.col("t")
    e = s.join(t, key).groupBy(key).agg(F.max("k").alias("groups"), F.sum(-p * F.log(p + 1e-9)).alias("h"))
    return e.select(key, "groups", F.when(F.col("groups") > 1, F.col("h") / F.log(F.col("groups").cast("double"))).otherwise(0.5).alias("balance"))


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: papers, edges, their density, the share of complete metadata, and the levels these stand for."""
    n = nodes.agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.col("year").isNotNull()).alias("y"), F.count_if(F.coalesce(F.trim("title"), F.lit("")) != "").alias("t"))
    x = n.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))
    d = F.col("edges") / F.greatest(F.lit(1), F.col("papers"))
    m = 0.5 * F.col("y") / F.greatest(F.lit(1), F.col("papers")) + 0.5 * F.col("t") / F.greatest(F.lit(1), F.col("papers"))
    return x.select(
        "papers", "edges", F.round(d, 4).alias("density"), F.round(m, 4).alias("metadata_ratio"),
        F.when(d >= 2.5, "Strong").when(d >= 0.9, "Medium").otherwise("Low").alias("citation_level"),
        F.when(m >= 0.82, "Strong").when(m >= 0.55, "Moderate").otherwise("Weak").alias("metadata_level"),
    )


#: Query vectors that are broadcast at once.
BLOCK = 100_000


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_column: str = "vec_id", column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, item, cosine, rank): the k nearest of all rows for each query vector, itself left out.

    A stated set of queries against all rows: the queries are broadcast in blocks of
    ``block`` at most; every task keeps the k best of each before anything is
    shuffled.  Null and zero vectors are near nothing.
    """
    unit = lambda c: F.transform(c, lambda x: x.cast("double") / F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double"))))
    ok = f"{column} is not null and exists({column}, x -> x <> 0)"
    a = vectors.filter(ok).select(F.col(id_column).alias("item"), unit(F.col(column)).alias("v"))
    q = queries.filter(ok).select(F.col(id_column).alias("query_id"), unit(F.col(column)).alias("q"))
    # blocks by hash: one for each half ``block`` of the queries, so that none comes near ``block``
    blocks = -(-2 * q.count() // block) if q.limit(block // 2 + 1).count() > block // 2 else 1
    parts = [q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else q for i in range(blocks)]
    dot = F.aggregate(F.zip_with("v", "q", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "item")

    def nearest(part: DataFrame) -> DataFrame:
        pairs = a.join(F.broadcast(part), F.col("item") != F.col("query_id"))
        return pairs.select("query_id", "item", F.round(dot, 6).alias("cosine")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    return reduce(DataFrame.unionByName, [nearest(p) for p in parts])
