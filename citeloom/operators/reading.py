"""From free-text queries to reading lists: seeds, expansion, ranking, sections, for a table of queries in one plan.

Everything is keyed by ``query_id``.  A query's pool is bounded by its seeds and
what each may bring, so windows over a query are small; the graph and the records
are joined, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import scores as S
from citeloom.operators.lookup import title_search
from citeloom.operators.skew import salted_join

#: Seeds of a query, references a seed brings, works listed as candidates, as foundational, and in a branch.
SEEDS, PER_PARENT, CANDIDATES, FOUNDATIONAL, IN_BRANCH = 20, 30, 40, 6, 8


def pool(queries: DataFrame, n: DataFrame, edges: DataFrame, seeds: int = SEEDS, per_parent: int = PER_PARENT) -> DataFrame:
    """(query_id, canonical_id, origin): works whose titles share most with a query, and the first references of each; found directly before found by reference."""
    s = title_search(queries, n, seeds).select("query_id", "canonical_id")
    refs = edges.groupBy("src", "dst").agg(F.min("ref_pos").alias("ref_pos")).join(s.select("query_id", F.col("canonical_id").alias("src")), "src")
    w = Window.partitionBy("query_id", "src").orderBy("ref_pos", "dst")
    hop = refs.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_parent).select("query_id", F.col("dst").alias("canonical_id"), F.lit(1).alias("o"))
    both = s.withColumn("o", F.lit(0)).unionByName(hop).groupBy("query_id", "canonical_id").agg(F.min("o").alias("o"))
    return both.select("query_id", "canonical_id", F.when(F.col("o") == 0, "api_search").otherwise("discovered").alias("origin"))


def ranked_pool(queries: DataFrame, n: DataFrame, edges: DataFrame, in_degree: DataFrame, as_of: int, intent: Column | None = None, **kw: int) -> DataFrame:
    """The pool with semantic, graph, canonical and recency scores, the fused relevance, its share of the query's best, and the rank.

    ``in_degree`` holds (canonical_id, in_degree); ``intent`` is a column of ``queries``
    (none: a plain query).  Citations count inside a query's pool only.
    """
    p = pool(queries, n, edges, **kw)
    e = edges.select("src", "dst").distinct()
    out = salted_join(e, p.groupBy(F.col("canonical_id").alias("src")).agg(F.collect_list("query_id").alias("qs")), "src", "inner", spread="dst")
    inside = out.select(F.explode("qs").alias("query_id"), F.col("dst").alias("canonical_id")).join(p.select("query_id", "canonical_id"), ["query_id", "canonical_id"], "left_semi")
    cited = inside.groupBy("query_id", "canonical_id").agg(F.count(F.lit(1)).alias("inbound"))
    q = queries.select("query_id", "query", (F.lit("exploratory") if intent is None else intent).alias("intent"))
    x = p.join(cited, ["query_id", "canonical_id"], "left").join(q, "query_id").join(n.select("canonical_id", "title", "abstract", "year", F.coalesce("domain", F.lit("unknown")).alias("domain")), "canonical_id").join(in_degree.select("canonical_id", "in_degree"), "canonical_id", "left")
    per = Window.partitionBy("query_id")
    year = F.when(F.col("year").between(1900, as_of), F.col("year"))
    x = x.withColumns({"inbound": F.coalesce("inbound", F.lit(0)), "semantic": S.vocabulary_coherence(F.col("query")), "canonical": F.least(F.lit(1.0), F.coalesce("in_degree", F.lit(0)) / 50.0), "recency": S.recency_alignment(year, as_of), "year": year})
    x = x.withColumn("graph", F.col("inbound") / F.greatest(F.lit(1), F.max("inbound").over(per)))
    x = x.withColumn("relevance", F.round(S.fused(F.col("semantic"), F.col("graph"), F.col("canonical"), F.col("recency"), F.col("intent")), 9))
    order = per.orderBy(F.desc("relevance"), "canonical_id")
    return x.withColumns({"rank": F.row_number().over(order), "norm": F.col("relevance") / F.when(F.max("relevance").over(per) > 0, F.max("relevance").over(per)).otherwise(1.0)}).drop("abstract", "in_degree", "query", "intent")


def sections(ranked: DataFrame) -> DataFrame:
    """(query_id, section, label, pos, canonical_id, relevance): foundational works, branches and candidates of every query.

    Foundational are the works most cited inside the pool; branches are the domains
    of the pool, each with its most cited works; candidates go by relevance.
    """
    by_citation = [F.desc("inbound"), F.desc("relevance"), "canonical_id"]
    f = ranked.filter("inbound >= 2").withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*by_citation))).filter(F.col("pos") <= FOUNDATIONAL)
    b = ranked.withColumn("pos", F.row_number().over(Window.partitionBy("query_id", "domain").orderBy(*by_citation))).filter(F.col("pos") <= IN_BRANCH)
    c = ranked.filter(F.col("rank") <= CANDIDATES).withColumn("pos", F.col("rank"))
    part = lambda df, s, label: df.select("query_id", F.lit(s).alias("section"), label.alias("label"), "pos", "canonical_id", "relevance")
    return part(f, "foundational", F.lit("")).unionByName(part(b, "branch", F.col("domain"))).unionByName(part(c, "candidate", F.lit("")))


def report(queries: DataFrame, lists: DataFrame, n: DataFrame) -> DataFrame:
    """(query_id, markdown): a reading list as text; its length is bounded by the sections, whatever the corpus."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled"))
    rows = lists.join(n.select("canonical_id", "title", "year"), "canonical_id", "left")
    line = F.concat(F.lit("- "), title, F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.lit("")))
    order = F.when(F.col("section") == "foundational", 0).when(F.col("section") == "branch", 1).otherwise(2)
    head = F.when(F.col("section") == "foundational", "## Foundational works").when(F.col("section") == "branch", F.concat(F.lit("## Branch: "), "label")).otherwise("## Candidates")
    parts = rows.groupBy("query_id", order.alias("o"), "label", head.alias("head")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    text = parts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "label", F.concat_ws("\n", "head", "body").alias("t")))), lambda x: x["t"]), "\n\n").alias("body"))
    return queries.join(text, "query_id", "left").select("query_id", F.concat_ws("\n\n", F.concat(F.lit("# "), "query"), "body").alias("markdown"))
