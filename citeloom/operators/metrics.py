"""The eight quality metrics of a result list and their composite, for all queries at once.

A result is four tables keyed by ``query_id``: queries (query_id, query, paper_count),
foundational (pos, paper_id, title, role, why), branches (branch_id, pos, titles,
why) and candidates (pos, title, semantic_score, year).  Every metric is one
aggregate over one of them; a query without rows in a table has the metric's
neutral value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.ranking import title_ratio

#: Weights of the composite.
COMPOSITE = {"intent_precision": 0.22, "canonical_hit_rate": 0.18, "foundational_quality": 0.18, "clean": 0.12, "branch_coherence": 0.12, "diversity": 0.08, "readability": 0.06, "grounded": 0.04}
#: Phrases that make an explanation boilerplate.
BOILERPLATE = ("graph expansion", "citation neighborhood", "may be incomplete")
#: Titles of one query that are read, candidates whose title may be a gold title, and candidates checked for noise.
TITLES, GOLD_POOL, NOISE_POOL = 40, 15, 20


def normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def tokens_of(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(normal(c), F.lit("[a-z0-9]+"), F.lit(0)))


def surfaced_titles(foundational: DataFrame, branches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, n, title): the titles a result shows, foundational works first, then branches, then candidates; blank ones left out."""
    f = foundational.select("query_id", F.lit(0).alias("part"), "pos", F.lit(0).alias("k"), "title")
    b = branches.select("query_id", F.lit(1).alias("part"), "pos", F.posexplode("titles").alias("k", "title"))
    c = candidates.select("query_id", F.lit(2).alias("part"), "pos", F.lit(0).alias("k"), "title")
    x = reduce(DataFrame.unionByName, (f, b, c)).filter("trim(title) <> ''")
    return x.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("part", "pos", "k", "title")).alias("n"), "title")


def intent_precision(queries: DataFrame, titles: DataFrame, most: int = TITLES) -> DataFrame:
    """The share of the first titles that hold a quarter of the query's words, or a word of four letters of it as a part."""
    q = queries.select("query_id", tokens_of(F.col("query")).alias("q")).filter("size(q) > 0")
    x = titles.filter(F.col("n") <= most).join(q, "query_id")
    hit = (F.size(F.array_intersect("q", tokens_of(F.col("title")))) / F.size("q") >= 0.25) | F.exists("q", lambda t: (F.length(t) > 3) & F.contains(normal(F.col("title")), t))
    return x.groupBy("query_id").agg(F.avg(hit.cast("double")).alias("intent_precision"))


def canonical_hits(gold: DataFrame, foundational: DataFrame, candidates: DataFrame, least: float = 0.72) -> DataFrame:
    """(query_id, canonical_hit_rate): 1 if a gold title (query_id, gold) is among the foundational works or first candidates, else 0.

    Titles agree if one holds the other or their matching ratio reaches ``least``.
    The ratio is computed only for pairs whose lengths allow it: two texts share at
    most the letters of the shorter.
    """
    pool = foundational.select("query_id", "title").unionByName(candidates.filter(F.col("pos") < GOLD_POOL).select("query_id", "title")).select("query_id", normal(F.col("title")).alias("t"))
    x = gold.select("query_id", normal(F.col("gold")).alias("g")).distinct().join(pool.distinct(), "query_id", "left")
    x = x.withColumn("holds", F.coalesce((F.col("t") != "") & (F.col("g") != "") & (F.contains("t", F.col("g")) | F.contains("g", F.col("t"))), F.lit(False)))
    short, both = F.least(F.length("t"), F.length("g")), F.length("t") + F.length("g")
    near = x.filter(~F.col("holds") & (2.0 * short / both >= least)).select("query_id", (title_ratio("t", "g") >= least).alias("holds"))
    return x.select("query_id", "holds").unionByName(near).groupBy("query_id").agg(F.max("holds").cast("double").alias("canonical_hit_rate"))


def foundational_quality(foundational: DataFrame) -> DataFrame:
    """The mean of what explanation and role of the foundational works are worth; a repeated title loses 0.4."""
    seen = F.row_number().over(Window.partitionBy("query_id", normal(F.col("title"))).orderBy("pos"))
    why, role = F.length(F.trim(F.coalesce("why", F.lit("")))), F.coalesce("role", F.lit(""))
    worth = 0.5 * F.when(why >= 24, 1.0).otherwise(0.3) + 0.5 * F.when((role != "") & (role != "exploratory"), 1.0).otherwise(0.6) - F.when(seen > 1, 0.4).otherwise(0.0)
    return foundational.select("query_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), worth)).alias("w")).groupBy("query_id").agg(F.avg("w").alias("foundational_quality"))


def noise_ratio(queries: DataFrame, candidates: DataFrame, most: int = NOISE_POOL) -> DataFrame:
    """The share of the first candidates with hardly a word of the query and little meaning in common."""
    q = queries.select("query_id", tokens_of(F.col("query")).alias("q")).filter("size(q) > 0")
    x = candidates.filter(F.col("pos") < most).join(q, "query_id")
    noisy = (F.size(F.array_intersect("q", tokens_of(F.col("title")))) / F.size("q") < 0.12) & (F.coalesce("semantic_score", F.lit(0.0)) < 0.35)
    return x.groupBy("query_id").agg(F.avg(noisy.cast("double")).alias("noise_ratio"))


def branch_coherence(branches: DataFrame) -> DataFrame:
    """The mean over a query's branches of the mean Jaccard similarity of their titles; 0.5 for a branch of one."""
    sets = F.transform(F.filter("titles", lambda t: F.coalesce(t, F.lit("")) != ""), tokens_of)
    x = branches.withColumn("s", sets).withColumn("pairs", F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))))))
    one = F.when(F.size("s") < 2, 0.5).otherwise(F.aggregate("pairs", F.lit(0.0), lambda s, v: s + v) / F.size("pairs"))
    return x.groupBy("query_id").agg(F.avg(one).alias("branch_coherence"), F.count(F.lit(1)).alias("n_branches"))


def readability(foundational: DataFrame, branches: DataFrame) -> DataFrame:
    """The share of explanations of 20 to 280 characters without boilerplate."""
    t = foundational.select("query_id", "why").unionByName(branches.select("query_id", "why")).select("query_id", F.coalesce("why", F.lit("")).alias("t"))
    ok = F.length("t").between(20, 280) & ~F.greatest(*[F.lower("t").contains(b) for b in BOILERPLATE])
    return t.groupBy("query_id").agg(F.avg(ok.cast("double")).alias("readability"))


def all_metrics(queries: DataFrame, foundational: DataFrame, branches: DataFrame, candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, the eight metrics, composite), rounded to four digits; one row per query."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    issues = foundational.groupBy("query_id").agg(F.sum(blank("paper_id").cast("int") + blank("title").cast("int")).alias("issues"), F.count(F.lit(1)).alias("checks"))
    years = candidates.groupBy("query_id").agg((F.max("year") - F.min("year")).alias("span"), F.count(F.lit(1)).alias("n_candidates"))
    parts = (intent_precision(queries, surfaced_titles(foundational, branches, candidates)), canonical_hits(gold, foundational, candidates), foundational_quality(foundational), noise_ratio(queries, candidates), branch_coherence(branches), readability(foundational, branches), issues, years)
    x = reduce(lambda a, b: a.join(b, "query_id", "left"), parts, queries.select("query_id", "paper_count"))
    z = lambda c, d: F.coalesce(F.col(c), F.lit(d))
    contradicted = (F.coalesce("paper_count", F.lit(0)) == 0) & (z("n_candidates", 0) > 0)
    issues_, checks = z("issues", 0) + F.when(contradicted, 2).otherwise(0), z("checks", 0) + F.when(contradicted, 2).otherwise(0)
    x = x.withColumns({
        "intent_precision": z("intent_precision", 0.0), "canonical_hit_rate": z("canonical_hit_rate", 1.0), "foundational_quality": z("foundational_quality", 0.5), "noise_ratio": z("noise_ratio", 0.0),
        "branch_coherence": z("branch_coherence", 0.0), "readability": z("readability", 0.5), "hallucination_risk": F.when(checks > 0, issues_ / checks).otherwise(0.0),
        "diversity": 0.6 * F.least(F.lit(1.0), z("n_branches", 0) / 4.0) + 0.4 * F.least(F.lit(1.0), z("span", 0) / 12.0),
    })
    x = x.withColumns({"clean": 1 - F.col("noise_ratio"), "grounded": 1 - F.col("hallucination_risk")})
    total = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in COMPOSITE.items()])
    shown = ("intent_precision", "canonical_hit_rate", "foundational_quality", "noise_ratio", "branch_coherence", "diversity", "readability", "hallucination_risk")
    return x.select("query_id", *[F.round(c, 4).alias(c) for c in shown], F.round(total, 4).alias("composite"))


def accuracy(predicted: Column, gold: Column) -> Column:
    """The share of rows whose labels agree but for case, outer white space and the separators of words."""
    same = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
    return F.avg(F.coalesce(same(predicted) == same(gold), F.lit(False)).cast("double"))


def summary(ranked: DataFrame, key: str = "query_id", most: int = 10) -> DataFrame:
    """(key, papers, top): how many works a query found and the ids of its first ones in order."""
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "canonical_id")))), lambda x: x["canonical_id"])
    return ranked.groupBy(key).agg(F.count(F.lit(1)).alias("papers"), top.alias("top"))
