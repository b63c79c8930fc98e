"""Growing and trimming a result: origins, bridges between sources, neighbourhoods, filters and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.ids import bare_id
from citeloom.operators.graph import by_confidence
from citeloom.staging import Stage

#: Origins that count as plain discovery.
DISCOVERED = ("discovered", "topic_discovered", "discovered_2hop")


def origin_map(seeds: DataFrame) -> DataFrame:
    """(key, origin): the origin of each seed (provider, id, origin, pos): an upload wins, else the first by position.

    Keys are lower case provider:id; topic and second-hop seeds count as discovered.
    """
    o = F.coalesce(F.trim("origin"), F.lit("discovered"))
    o = F.when(o.isin(*DISCOVERED), "discovered").otherwise(o)
    x = seeds.select(F.lower(F.concat_ws(":", F.trim("provider"), F.trim("id"))).alias("key"), o.alias("o"), "pos")
    g = x.groupBy("key").agg(F.max((F.col("o") == "uploaded_pdf").cast("int")).alias("up"), F.min(F.struct(F.col("pos").isNull(), "pos", "o")).alias("m"))
    return g.select("key", F.when(F.col("up") == 1, "uploaded_pdf").otherwise(F.col("m.o")).alias("origin"))


def bridged_references(n: DataFrame) -> DataFrame:
    """(canonical_id, references, bridged): preprints with the references of the openalex records that carry their arXiv id or DOI.

    One sorted union of bare references per preprint; preprints without a bridge keep
    their own.
    """
    own = n.filter("canonical_id like 'arxiv:%'").select("canonical_id", F.explode(F.array_distinct(F.array(bare_id(F.col("canonical_id")), bare_id(F.col("doi"))))).alias("key")).filter("key is not null")
    other = n.filter("canonical_id like 'openalex:%'").select(F.col("references").alias("r"), F.explode(F.array_distinct(F.array(bare_id(F.col("doi")), bare_id(F.col("arxiv_id"))))).alias("key")).filter("key is not null")
    refs = lambda c: F.filter(F.transform(c, bare_id), lambda x: x.isNotNull())
    more = own.join(other, "key").select("canonical_id", F.explode(refs("r")).alias("ref"), F.lit(1).alias("bridged"))
    mine = n.filter("canonical_id like 'arxiv:%'").select("canonical_id", F.explode_outer(refs("references")).alias("ref"), F.lit(0).alias("bridged"))
    g = mine.unionByName(more).groupBy("canonical_id").agg(F.array_sort(F.collect_set("ref")).alias("references"), F.max("bridged").alias("bridged"))
    return g.select("canonical_id", "references", (F.col("bridged") == 1).alias("bridged"))


def near_anchors(hops: DataFrame, score: str, k: int = 28) -> DataFrame:
    """The first ``k`` works by distance to the anchors, then score, then id: a bounded neighbourhood."""
    return hops.orderBy("hops", F.desc_nulls_last(score), "canonical_id").limit(k)


def neighbourhood(n: DataFrame, edges: DataFrame, key: str, score: str, k: int = 28) -> DataFrame:
    """(key, canonical_id, place): up to ``k`` nodes of every result that hang together.

    Nodes (key, canonical_id, score, is_seed): the seeds come first (the three best
    where there are none), then, breadth first, the neighbours of each node taken, the
    best scored first and the smaller id among equals; what is left is filled by score.
    Every round joins the last round's nodes, ``k`` a result at most, with the edges
    (key, src, dst); seeds are all kept, even more than ``k``.
    """
    stage = Stage(n.sparkSession, "neighbourhood")
    node = stage.put(n.select(key, "canonical_id", F.coalesce(score, F.lit(0.0)).alias("s"), F.coalesce("is_seed", F.lit(False)).alias("seed")).distinct())
    best = Window.partitionBy(key).orderBy(F.desc("s"), "canonical_id")
    flagged = node.filter("seed").select(key).distinct()
    seeds = node.filter("seed").unionByName(node.join(flagged, key, "left_anti").withColumn("_r", F.row_number().over(best)).filter("_r <= 3").drop("_r"))
    both = edges.select(key, F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(key, F.col("dst").alias("a"), F.col("src").alias("b"))).filter("a <> b").distinct()
    inner = node.select(key, F.col("canonical_id").alias("b"), "s")
    near = stage.put(both.join(inner, [key, "b"]))
    taken = stage.put(seeds.select(key, "canonical_id", F.row_number().over(best).alias("place")))
    frontier = taken
    while True:
        size = taken.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        reached = near.join(frontier.select(key, F.col("canonical_id").alias("a"), "place"), [key, "a"]).join(taken.select(key, F.col("canonical_id").alias("b")), [key, "b"], "left_anti")
        # a node goes with the first of those that lead to it
        first = reached.groupBy(key, "b").agg(F.min("place").alias("parent"), F.max("s").alias("s"))
        order = Window.partitionBy(key).orderBy("parent", F.desc("s"), "b")
        new = stage.put(first.withColumn("_k", F.row_number().over(order)).join(size, key).filter(F.col("_n") + F.col("_k") <= k).select(key, F.col("b").alias("canonical_id"), (F.col("_n") + F.col("_k")).cast("int").alias("place")))
        if new.isEmpty():
            break
        taken, frontier = stage.put(taken.unionByName(new)), new
    size = taken.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rest = node.join(taken.select(key, "canonical_id"), [key, "canonical_id"], "left_anti").withColumn("_k", F.row_number().over(best)).join(size, key).filter(F.col("_n") + F.col("_k") <= k)
    return taken.unionByName(rest.select(key, "canonical_id", (F.col("_n") + F.col("_k")).cast("int").alias("place")))


def visible(n: DataFrame, edges: DataFrame, score: str, least: float, always: Column, hide_weak: bool = True) -> tuple[DataFrame, DataFrame]:
    """Works of at least ``least`` or always shown, and the edges with both ends among them; weak edges are hidden.

    Weak: low confidence, or a context that is only guessed from the abstract.
    """
    kept = n.filter((F.col(score) >= least) | always)
    ids = kept.select("canonical_id")
    e = edges.join(ids.withColumnRenamed("canonical_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("canonical_id", "dst"), "dst", "left_semi")
    if hide_weak:
        weak = (F.lower(F.trim("confidence")) == "low") | (F.col("context_source") == "abstract_proxy")
        e = e.filter(~F.coalesce(weak, F.lit(False)))
    return kept, e


def strongest_edges(edges: DataFrame, key: str, k: int = 36) -> DataFrame:
    """(key, src, dst, rank): the first ``k`` edges of each result by confidence and repeats; low ones are left out."""
    c = by_confidence(F.col("confidence"), {"high": 3.0, "medium": 2.0, "low": 1.0}, 0.0)
    g = edges.groupBy(key, "src", "dst").agg(F.max(c).alias("c"), F.count(F.lit(1)).alias("n")).filter("c >= 2")
    w = Window.partitionBy(key).orderBy(F.desc("c"), F.desc("n"), "src", "dst")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(key, "src", "dst", "rank")


def shared_by_all(members: DataFrame, edges: DataFrame, key: str, branch: str) -> DataFrame:
    """(key, branch, shared): references that every member of a branch with any references has; branches of one count none."""
    e = edges.select(F.col("src").alias("canonical_id"), "dst").distinct()
    x = members.select(key, branch, "canonical_id").join(e, "canonical_id")
    size = x.groupBy(key, branch).agg(F.count_distinct("canonical_id").alias("n"))
    c = x.groupBy(key, branch, "dst").agg(F.count_distinct("canonical_id").alias("k")).join(size, [key, branch]).filter("k = n and n > 1")
    got = c.groupBy(key, branch).agg(F.count(F.lit(1)).alias("shared"))
    return size.join(got, [key, branch], "left").select(key, branch, F.coalesce("shared", F.lit(0)).alias("shared"))


def reference_statistics(n: DataFrame, edges: DataFrame, least: int = 5, strong_refs: int = 50, strong_edges: int = 30) -> DataFrame:
    """One row: references, resolved ones, whether a result this thin needs repair, and how good the evidence is."""
    refs = n.agg(F.sum(F.when(F.col("references").isNull(), 0).otherwise(F.size("references"))).alias("references_total"), F.count(F.lit(1)).alias("papers"))
    x = refs.crossJoin(edges.agg(F.count(F.lit(1)).alias("resolved")))
    quality = F.when(F.col("resolved") == 0, "low").when((F.col("references_total") >= strong_refs) & (F.col("resolved") >= strong_edges), "high").otherwise("medium")
    return x.select("papers", "references_total", "resolved", (F.col("resolved") < least).alias("repair"), quality.alias("evidence"))


def in_domains(n: DataFrame, allowed: list[str]) -> DataFrame:
    """Works of the allowed domains; a work without a domain passes."""
    d = F.lower(F.trim("domain"))
    return n.filter(d.isNull() | (d == "") | d.isin(*allowed))


def search_title(title: Column) -> Column:
    """A printed title without the wording of proceedings, pages and volumes; null below six characters."""
    q = F.trim(F.regexp_replace(title, r"\s+", " "))
    for pattern in (
        r"(?i)^\s*(the\s+)?(\d{1,2}(st|nd|rd|th)\s+)?(annual\s+)?(international\s+)?(conference|workshop|symposium)\s+on\s+", r"(?i)^\s*(in\s+)?proceedings\s+of\s+(the\s+)?", r"(?i)^\s*proc\.\s+",
        r"(?i)\s*[-–,]\s*(pages?|pp\.)\s*\d.*$", r"(?i)\s*[,;]\s*(vol\.|volume|issue)\s*.+$",
    ):
        q = F.trim(F.regexp_replace(q, pattern, ""))
    return F.when(F.length(q) >= 6, q)
