"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task should take at most.
HOT_ROWS = 200_000
#: Keys that may be salted; bounds the broadcast. Hot keys beyond it are left to AQE's skew join.
MAX_HOT = 2_000


def hot_keys(left: DataFrame, key: str, hot_rows: int = HOT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """(key, salts): the keys with more than ``hot_rows`` rows and how many parts each gets; ``MAX_HOT`` rows at most.

    ``counts`` (key, n) saves the count where the caller has one.
    """
    counts = counts if counts is not None else left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.filter((F.col("n") > hot_rows) & F.col(key).isNotNull())
        .orderBy(F.desc("n"), key)
        .limit(MAX_HOT)
        .select(key, F.ceil(F.col("n") / hot_rows).cast("int").alias("_salts"))
    )


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", spread: str | None = None, hot_rows: int = HOT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key``, the hot keys of ``left`` spread over several tasks.

    ``right`` must hold each key once, so its copies for the salts stay few.
    ``spread`` is the column of ``left`` whose hash picks the salt (all columns if
    none).  ``how``: inner, left, left_semi or left_anti.  Null keys match nothing.
    """
    hot = F.broadcast(hot_keys(left, key, hot_rows, counts))
    h = F.xxhash64(F.col(spread)) if spread else F.xxhash64(*[F.col(c) for c in left.columns])
    a = left.join(hot, key, "left").withColumn("_salt", F.pmod(h, F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    b = (
        right.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    return a.join(b, [key, "_salt"], how).drop("_salt")
