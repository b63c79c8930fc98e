"""What a ranking says of itself: distributions of signals, coverage, budgets and warnings, for many queries at once.

Nodes are rows with the key of their query; every function is an aggregate or a
projection keyed by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNALS = ("semantic_score", "graph_score", "canonicality_score", "relevance_raw")


def signal_stats(nodes: DataFrame, key: str, signals: dict[str, Column] | tuple[str, ...] = SIGNALS) -> DataFrame:
    """(key, signal, mean, stdev, min, max): the spread of every signal over a query's nodes, nulls as 0; one aggregate."""
    cols = {s: F.col(s) for s in signals} if not isinstance(signals, dict) else signals
    x = nodes.select(key, *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in cols.items()])
    g = x.groupBy(key).agg(*[F.struct(F.lit(n).alias("signal"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("stdev"), F.min(n).alias("min"), F.max(n).alias("max")).alias(n) for n in cols])
    return g.select(key, F.explode(F.array(*cols)).alias("s")).select(key, "s.*")


def contributions(nodes: DataFrame, key: str, weights: tuple[float, float, float]) -> DataFrame:
    """The same of the weighted terms of the fusion."""
    terms = zip(("weighted_semantic", "weighted_graph", "weighted_canonicality"), SIGNALS, weights)
    return signal_stats(nodes, key, {n: F.col(c) * w for n, c, w in terms})


def observability(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """One row per query: candidates, edges and their density, spread of the semantic scores, how far the largest rank stands out, references kept.

    ``nodes`` has semantic_score, pagerank_norm and n_references; ``edges`` the key.
    Eight references a candidate count as complete.
    """
    n = nodes.groupBy(key).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.stddev_pop(F.coalesce("semantic_score", F.lit(0.0))).alias("dispersion"),
        (F.max(F.coalesce("pagerank_norm", F.lit(0.0))) - F.avg(F.coalesce("pagerank_norm", F.lit(0.0)))).alias("centrality_gap"),
        F.coalesce(F.sum("n_references"), F.lit(0)).alias("references"),
    )
    e = edges.groupBy(key).agg(F.count(F.lit(1)).alias("edges"))
    x = n.join(e, key, "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return x.select(
        key, "candidates", "edges", (F.col("edges") / F.greatest(F.lit(1), F.col("candidates"))).alias("density"), "dispersion", "centrality_gap",
        F.least(F.lit(1.0), F.col("references") / (F.col("candidates") * 8.0)).alias("reference_ratio"),
    )


def control_means(nodes: DataFrame, key: str) -> DataFrame:
    """(key, drift, connectivity, multiplier): means over a query's nodes; missing values count as 0, 0 and 1."""
    return nodes.groupBy(key).agg(*[F.avg(F.coalesce(c, F.lit(d))).alias(c) for c, d in (("drift", 0.0), ("connectivity", 0.0), ("multiplier", 1.0))])


def discovery_budget(q: DataFrame) -> DataFrame:
    """The options a query is discovered with; columns ambiguity, seeds, top_n, two_hop, budget, concept, coupling, topic.

    Queries that may mean several things are searched more narrowly; fewer than
    twelve seeds lower the thresholds; fewer seeds than shown works deepen the search.
    """
    amb = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("ambiguity", F.lit(0.0))))
    factor = (amb - 0.5) / 0.5
    unsure = amb >= 0.5
    top = F.greatest(F.lit(10), F.least(F.lit(200), F.coalesce(F.nullif("top_n", F.lit(0)), F.lit(50))))
    clip = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), c))
    budget = clip(F.coalesce(F.nullif("budget", F.lit(0)), F.lit(120)), 30, 300)
    budget = F.when(unsure, clip(F.floor(budget * F.greatest(F.lit(0.55), 1.0 - 0.35 * factor)), 30, 300)).otherwise(budget).cast("int")
    concept = clip(F.coalesce(F.nullif("concept", F.lit(0.0)), F.lit(0.25)), 0.0, 1.0)
    concept = F.when(unsure, F.least(F.lit(1.0), concept + 0.05 + 0.12 * factor)).otherwise(concept)
    coupling = clip(F.coalesce(F.nullif("coupling", F.lit(0)), F.lit(3)), 2, 8)
    topic = clip(F.coalesce("topic", F.lit(0.0)), 0.0, 1.0)
    cold = F.col("seeds") < 12
    few = F.col("seeds") < F.col("o.top_n")
    x = q.withColumn("o", F.struct(top.alias("top_n"), budget.alias("budget"), concept.alias("concept"), coupling.alias("coupling"), topic.alias("topic")))
    deeper = F.when(few & ~F.col("two_hop"), F.greatest(F.col("o.budget"), F.least(F.lit(220), F.col("o.top_n") * 2))).when(few & F.col("two_hop") & (F.col("o.budget") < 200), F.least(F.lit(260), F.greatest(F.col("o.budget") + 60, F.col("o.top_n") * 2))).otherwise(F.col("o.budget"))
    keep = [c for c in q.columns if c not in ("ambiguity", "seeds", "top_n", "two_hop", "budget", "concept", "coupling", "topic")]
    return x.select(
        *keep, F.col("o.top_n").alias("top_n"), (F.col("two_hop") | few).alias("two_hop"), deeper.alias("budget"),
        F.when(cold, F.greatest(F.lit(0.15), F.col("o.concept") - 0.15)).otherwise(F.col("o.concept")).alias("concept"),
        F.when(cold, F.least(F.col("o.coupling"), F.lit(2))).otherwise(F.col("o.coupling")).alias("coupling"),
        F.when(cold, F.greatest(F.lit(0.2), F.col("o.topic"))).otherwise(F.col("o.topic")).alias("topic"),
        F.when(unsure, 0.35 + 0.25 * factor).otherwise(0.45).alias("bridge_factor"),
    )


def evidence(nodes: Column, edges: Column, references: Column) -> Column:
    """low where there are neither references nor edges, high from 50 references and 30 edges on, else medium."""
    return F.when((references == 0) & (edges == 0), "low").when((references >= 50) & (edges >= 30), "high").otherwise("medium")


def warnings_of(nodes: Column, edges: Column, references: Column, seeds: Column) -> Column:
    """Codes of what is thin about a result."""
    flags = (((nodes >= 2) & (edges < 2), "few_links"), ((nodes >= 4) & (references < 20), "few_references"), ((seeds < 3) & (nodes >= 2), "few_anchors"))
    return F.array_compact(F.array(*[F.when(f, c) for f, c in flags]))


def relevance_norm(nodes: DataFrame, key: str, score: str, out: str = "relevance_norm") -> DataFrame:
    """``out``: the score over the largest of its query (1 where that is not positive). One aggregate, joined back."""
    top = nodes.groupBy(key).agg(F.max(score).alias("_m"))
    return nodes.join(top, key).withColumn(out, F.col(score) / F.when(F.col("_m") > 0, F.col("_m")).otherwise(1.0)).drop("_m")


def coherence_adjusted(relevance: Column, coherence: Column, bridge: Column, penalty: Column, bridge_factor: Column | float = 0.45) -> Column:
    """Relevance by coherence; bridges and works of a strange field are pushed down."""
    f = bridge_factor if isinstance(bridge_factor, Column) else F.lit(bridge_factor)
    out = relevance * (0.55 + 0.45 * F.coalesce(F.nullif(coherence, F.lit(0.0)), F.lit(0.5)))
    out = out * F.when(F.coalesce(bridge, F.lit(False)), F.greatest(F.lit(0.15), f)).otherwise(1.0)
    return F.greatest(F.lit(0.0), out * F.when(penalty >= 0.34, 0.35).when(penalty >= 0.22, 0.62).otherwise(1.0))


def confidence_tier(coherence: Column, semantic: Column, bridge: Column, cluster: Column) -> Column:
    """How sure it is that a work belongs to the query."""
    return (
        F.when(cluster.isNotNull(), "cross_domain_bridge").when(bridge, "exploratory_connection").when((coherence >= 0.62) & (semantic >= 0.45), "core_intent")
        .when((coherence >= 0.45) | (semantic >= 0.35), "moderate_intent").when(semantic >= 0.22, "lexically_related").otherwise("citation_adjacent")
    )


def edge_bucket(confidence: Column, dashed: Column) -> Column:
    """potential for dashed edges and those of low confidence, else supported."""
    return F.when(dashed | (F.lower(confidence) == "low"), "potential").otherwise("supported")


def oldest_signal(nodes: DataFrame, key: str) -> DataFrame:
    """(key, canonical_id): per query the oldest dated work, hubs and related works first among its year; the best ranked where none is dated."""
    dated = F.min_by("canonical_id", F.when(F.col("year").isNotNull(), F.struct("year", (~F.coalesce("is_hub", F.lit(False))).alias("h"), (-F.coalesce("relation", F.lit(0.0))).alias("r"), "rank")))
    return nodes.groupBy(key).agg(F.coalesce(dated, F.min_by("canonical_id", "rank")).alias("canonical_id"))


def hub_linked(nodes: DataFrame, hubs: DataFrame, edges: DataFrame) -> DataFrame:
    """(canonical_id, linked): whether an edge in either direction joins a node to a hub (hub)."""
    h = hubs.select("hub").distinct()
    ends = edges.select(F.col("src").alias("canonical_id"), F.col("dst").alias("hub")).unionByName(edges.select(F.col("dst").alias("canonical_id"), F.col("src").alias("hub")))
    at = ends.join(h, "hub", "left_semi").select("canonical_id", F.lit(True).alias("l")).distinct()
    return nodes.select("canonical_id").join(at, "canonical_id", "left").select("canonical_id", F.coalesce("l", F.lit(False)).alias("linked"))


def without_suppressed(recommended: DataFrame, nodes: DataFrame, id_column: str = "canonical_id") -> DataFrame:
    """Recommendations but those whose node is suppressed, a bridge, or of a strange field with little coherence."""
    bad = F.coalesce("suppressed", F.lit(False)) | F.coalesce("is_bridge", F.lit(False)) | ((F.coalesce("penalty", F.lit(0.0)) >= 0.34) & (F.coalesce("coherence", F.lit(1.0)) < 0.38))
    return recommended.join(nodes.filter(bad).select(id_column).distinct(), id_column, "left_anti")
