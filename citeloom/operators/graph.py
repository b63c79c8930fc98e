"""The citation graph: reference resolution, couplings, degrees, expansion, ranks and distances.

Edges are bags (two references to one work are two edges); couplings count
distinct neighbours.  Works cited by a large share of all papers are the hot keys
here: reference resolution salts them, and coupling leaves them to the suffix
that prefix filtering may skip, or cuts their lists of citers into blocks.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.ids import bare_id, blank_to_null
from citeloom.operators.skew import salted_join
from citeloom.staging import Stage

ID_COLUMNS = ("doi", "openalex_id", "arxiv_id", "semantic_scholar_id", "canonical_id")


def nodes(papers: DataFrame, *columns: str) -> DataFrame:
    """One row per canonical_id with ``pos`` and ``columns``: the first to arrive."""
    cols = list(dict.fromkeys([c for c in columns if c not in ("canonical_id", "pos")]))
    first = F.min_by(F.struct("pos", *cols), F.struct(F.col("pos").isNull(), "pos"))
    return papers.filter("canonical_id is not null").groupBy("canonical_id").agg(first.alias("_r")).select("canonical_id", "_r.*")


def aliases(n: DataFrame) -> DataFrame:
    """(key, dst): every bare identifier of the nodes and the first node that carries it."""
    keys = n.select("canonical_id", "pos", F.explode(F.array_distinct(F.array(*[bare_id(F.col(c)) for c in ID_COLUMNS]))).alias("key")).filter("key is not null")
    return keys.groupBy("key").agg(F.min_by("canonical_id", F.struct(F.col("pos").isNull(), "pos", "canonical_id")).alias("dst"))


def resolve_references(n: DataFrame) -> DataFrame:
    """(src, ref_pos, ref, dst): references that name a node; an exact canonical_id before any other identifier."""
    refs = n.select(F.col("canonical_id").alias("src"), F.posexplode("references").alias("ref_pos", "ref")).filter(F.col("ref").isNotNull())
    refs = refs.withColumn("key", bare_id(F.col("ref")))
    own = n.select(F.col("canonical_id").alias("ref"), F.lit(True).alias("exact"))
    by_id = salted_join(refs, own, "ref", "left", spread="src")
    found = salted_join(by_id, aliases(n), "key", "left", spread="src")
    return found.select("src", "ref_pos", "ref", F.when(F.col("exact"), F.col("ref")).otherwise(F.col("dst")).alias("dst")).filter("dst is not null")


def edge_context(edges: DataFrame, n: DataFrame) -> DataFrame:
    """Edges with (context_source, confidence): medium where the abstract of the citing work holds the cited title's first word."""
    word = F.lower(F.split("title", " ")[0])
    src = n.select(F.col("canonical_id").alias("src"), F.lower("abstract").alias("_a"))
    dst = n.select(F.col("canonical_id").alias("dst"), F.when(word != "", word).alias("_w"))
    j = salted_join(salted_join(edges, dst, "dst", "left", spread="src"), src, "src", "left", spread="dst")
    hit = F.coalesce(F.instr(F.col("_a"), F.col("_w")) > 0, F.lit(False))
    return j.select(*edges.columns, F.when(hit, "abstract_proxy").otherwise("unresolved_context").alias("context_source"), F.when(hit, "medium").otherwise("low").alias("confidence"))


def degrees(n: DataFrame, edges: DataFrame) -> DataFrame:
    """(canonical_id, in_degree, out_degree, degree) of every node, repeated edges counted."""
    ends = edges.select(F.col("src").alias("canonical_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("canonical_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    d = ends.groupBy("canonical_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.select("canonical_id").join(d, "canonical_id", "left").select("canonical_id", z("in_degree"), z("out_degree")).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def cocitation(edges: DataFrame, min_shared: int = 2) -> DataFrame:
    """(a, b, shared), a < b: works cited together by at least ``min_shared`` papers. Lists of references are short, so the pairs are too."""
    e = edges.select("src", "dst").distinct()
    return e.select("src", F.col("dst").alias("a")).join(e.select("src", F.col("dst").alias("b")), "src").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= min_shared)


def coupling(edges: DataFrame, min_shared: int = 2, key: str = "dst") -> DataFrame:
    """(a, b, shared), a < b: papers that share at least ``min_shared`` references.

    Prefix filtering, exact: with the references of each paper in one global order,
    rarest first, two papers that share k of them share one among all but the last
    k - 1, so the most cited works need not make pairs.  Candidates are verified on
    the full lists.  For a single shared reference every pair counts and there is
    nothing to filter: see ``coupled_blocks``.
    """
    e = edges.select("src", F.col(key).alias("dst")).distinct()
    if min_shared <= 1:
        return coupled_blocks(e)
    df = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
    shared = df.filter("n > 1")
    lists = salted_join(e, shared, "dst", "inner", spread="src").groupBy("src").agg(F.array_sort(F.collect_list(F.struct("n", "dst"))).alias("l"))
    lists = lists.filter(F.size("l") >= min_shared).select("src", F.transform("l", lambda x: x["dst"]).alias("l"))
    prefix = lists.select("src", F.explode(F.slice("l", F.lit(1), F.size("l") - (min_shared - 1))).alias("dst"))
    c = prefix.select("dst", F.col("src").alias("a")).join(prefix.select("dst", F.col("src").alias("b")), "dst").filter("a < b").select("a", "b").distinct()
    full = c.join(lists.select(F.col("src").alias("a"), F.col("l").alias("la")), "a").join(lists.select(F.col("src").alias("b"), F.col("l").alias("lb")), "b")
    return full.select("a", "b", F.size(F.array_intersect("la", "lb")).cast("long").alias("shared")).filter(F.col("shared") >= min_shared)


#: Pairs, counted once for every work they share, that one task makes on average.
TASK_PAIRS = 1_000_000


def coupled_blocks(e: DataFrame, task_pairs: int = TASK_PAIRS) -> DataFrame:
    """(a, b, shared), a < b: every pair of papers that share a reference; ``e`` holds distinct (src, dst).

    Pairs are made where they are counted and never shuffled: papers fall into blocks,
    each work sends the lists of its citers to every two blocks that both cite it, and
    the task of these two blocks sees all that a pair shares.  A work with n citers
    moves n times the number of blocks instead of n * n / 2 pairs.
    """
    e = Stage(e.sparkSession, "coupling").put(e)
    total = e.groupBy("dst").agg(F.count(F.lit(1)).cast("double").alias("n")).agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0] or 0.0
    tasks = max(int(total // task_pairs) + 1, int(e.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # sixteen times as many pairs of blocks as tasks even these out
    blocks = int((32 * tasks) ** 0.5) + 1
    lists = e.groupBy("dst", F.pmod(F.xxhash64("src"), F.lit(blocks)).cast("int").alias("k")).agg(F.collect_list("src").alias("l"))
    x, y = lists.select("dst", F.col("k").alias("kx"), F.col("l").alias("lx")), lists.select("dst", F.col("k").alias("ky"), F.col("l").alias("ly"))
    met = x.join(y.hint("merge"), "dst").filter("kx < ky or kx = ky and size(lx) > 1").select((F.col("kx") * blocks + F.col("ky")).alias("k"), (F.col("kx") == F.col("ky")).alias("own"), "lx", "ly")
    p = met.repartition(tasks, "k").select("k", "own", F.explode("lx").alias("p"), "ly").select("k", "own", "p", F.explode("ly").alias("q")).filter("not own or p < q")
    return p.groupBy("k", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.count(F.lit(1)).alias("shared")).drop("k")


def strong_coupling_edges(edges: DataFrame, raw_refs: DataFrame, min_shared: int = 3) -> DataFrame:
    """Synthetic (a, b, shared) edges: papers that share raw bare references but cite each other in neither direction."""
    direct = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return coupling(raw_refs, min_shared, "ref").join(direct, ["a", "b"], "left_anti")


def relation_scores(n: DataFrame, edges: DataFrame, anchors: DataFrame, w_direct: float = 2.0, w_coupling: float = 0.6, w_cocitation: float = 0.8) -> DataFrame:
    """(canonical_id, score, direct_hits, max_coupling, max_cocitation) of the nodes that are no anchors.

    Direct citations, shared references and shared citers of each node and anchor,
    each damped by the square root of the two sizes.  Nodes without any evidence are
    left out.  ``anchors`` holds (anchor).
    """
    d = degrees(n, edges)
    e = edges.select("src", "dst").distinct()
    root = lambda a, b: F.sqrt(F.greatest(a, F.lit(1)) * F.greatest(b, F.lit(1)))
    deg = lambda k: d.select(F.col("canonical_id").alias(k), F.col("degree").alias(f"d_{k}"))
    both = e.select(F.col("src").alias("c"), F.col("dst").alias("anchor")).unionByName(e.select(F.col("dst").alias("c"), F.col("src").alias("anchor"))).distinct()
    direct = both.join(anchors, "anchor").join(deg("c"), "c").join(deg("anchor"), "anchor")
    direct = direct.select("c", (F.lit(w_direct) / root(F.col("d_c"), F.col("d_anchor"))).alias("s"), F.lit(1).alias("hit"), F.lit(0).cast("long").alias("cpl"), F.lit(0).cast("long").alias("coc"))

    z = F.lit(0).cast("long")
    part = lambda s, cpl, coc: ("c", s.alias("s"), F.lit(0).alias("hit"), cpl.alias("cpl"), coc.alias("coc"))
    # shared references: an anchor adds x / sqrt(kc * ka) for its x works shared with c; summed over the anchors that is the sum, over the works
    # of c, of what the anchors citing each are worth, so hot works make no pairs
    size = e.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    worth = e.join(anchors.withColumnRenamed("anchor", "src"), "src").join(size, "src").groupBy("dst").agg(F.sum(1.0 / F.sqrt("k")).alias("w"))
    coupled = salted_join(e, worth, "dst", "inner", spread="src").groupBy("src").agg(F.sum("w").alias("w")).join(size, "src")
    coupled = coupled.select(F.col("src").alias("c"), (F.lit(w_coupling) * F.col("w") / F.sqrt("k")).alias("s"))
    # the most works shared with one anchor: pairs that share two or more by prefix filtering, one where there is none
    two = coupling(e, 2)
    most = two.select(F.col("a").alias("c"), F.col("b").alias("anchor"), "shared").unionByName(two.select(F.col("b").alias("c"), F.col("a").alias("anchor"), "shared"))
    most = most.join(anchors, "anchor", "left_semi").groupBy("c").agg(F.max("shared").alias("x"))
    coupled = coupled.join(most, "c", "left").select(*part(F.col("s"), F.coalesce("x", F.lit(1).cast("long")), z))
    # shared citers: pairs within one reference list
    size = e.groupBy("dst").agg(F.count(F.lit(1)).alias("k"))
    at = e.join(anchors.withColumnRenamed("anchor", "dst"), "dst").select(F.col("dst").alias("anchor"), "src")
    cited = at.join(e.select(F.col("dst").alias("c"), "src"), "src").filter("c <> anchor").groupBy("c", "anchor").agg(F.count(F.lit(1)).alias("x"))
    cited = cited.join(size.select(F.col("dst").alias("c"), F.col("k").alias("kc")), "c").join(size.select(F.col("dst").alias("anchor"), F.col("k").alias("ka")), "anchor")
    cited = cited.select(*part(F.lit(w_cocitation) * F.col("x") / root(F.col("kc"), F.col("ka")), z, F.col("x")))

    parts = direct.unionByName(coupled).unionByName(cited)
    parts = parts.join(anchors.withColumnRenamed("anchor", "c"), "c", "left_anti")
    s = parts.groupBy("c").agg(F.sum("s").alias("score"), F.sum("hit").alias("direct_hits"), F.max("cpl").alias("max_coupling"), F.max("coc").alias("max_cocitation"))
    return s.filter("score > 1e-9").withColumnRenamed("c", "canonical_id")


def relation_reason() -> Column:
    """Why a node was added, as a code."""
    return F.when(F.col("max_cocitation") >= 2, "cocitation").when(F.col("max_coupling") >= 2, "coupling").when(F.col("direct_hits") > 0, "direct").otherwise("reference_pool")


def missing_links(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(canonical_id, citing_anchors): works that are no anchors and how many anchors cite them."""
    e = edges.select(F.col("src").alias("anchor"), "dst").distinct().join(anchors, "anchor", "left_semi")
    return e.join(anchors.withColumnRenamed("anchor", "dst"), "dst", "left_anti").groupBy(F.col("dst").alias("canonical_id")).agg(F.count(F.lit(1)).alias("citing_anchors"))


def references_outside(n: DataFrame) -> DataFrame:
    """(key, citing): bare references that no node answers to, and how many nodes hold them."""
    refs = n.select(F.col("canonical_id").alias("src"), F.explode(F.array_distinct(F.transform("references", bare_id))).alias("key")).filter("key is not null")
    return refs.groupBy("key").agg(F.count(F.lit(1)).alias("citing")).join(aliases(n), "key", "left_anti")


def second_hop(edges: DataFrame, n: DataFrame, seeds: DataFrame, per_parent: int = 30) -> DataFrame:
    """(parent, canonical_id, rank): each seed's first ``per_parent`` references in order that are no seeds themselves."""
    e = edges.join(seeds.select(F.col("seed").alias("src")), "src").groupBy("src", "dst").agg(F.min("ref_pos").alias("ref_pos"))
    e = e.join(seeds.select(F.col("seed").alias("dst")), "dst", "left_anti")
    w = Window.partitionBy("src").orderBy("ref_pos", "dst")
    return e.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_parent).select(F.col("src").alias("parent"), F.col("dst").alias("canonical_id"), "rank")


def broaden(edges: DataFrame, n: DataFrame, seeds: DataFrame, refs_cap: int = 35, citers_cap: int = 25) -> DataFrame:
    """(canonical_id, origin): references and citers of the seeds, capped per seed, once each, references before citers."""
    w = lambda k, o: Window.partitionBy(k).orderBy(*o)
    s = seeds.select(F.col("seed"))
    e = edges.groupBy("src", "dst").agg(F.min("ref_pos").alias("ref_pos"))
    refs = e.join(s.withColumnRenamed("seed", "src"), "src").withColumn("r", F.row_number().over(w("src", ["ref_pos", "dst"]))).filter(F.col("r") <= refs_cap).select(F.col("dst").alias("canonical_id"), F.lit(0).alias("o"))
    # citers of a hot work: the rank filter becomes a limit per task before the shuffle
    citers = e.join(s.withColumnRenamed("seed", "dst"), "dst").withColumn("r", F.row_number().over(w("dst", ["src"]))).filter(F.col("r") <= citers_cap).select(F.col("src").alias("canonical_id"), F.lit(1).alias("o"))
    pool = refs.unionByName(citers).groupBy("canonical_id").agg(F.min("o").alias("o"))
    return pool.join(s.withColumnRenamed("seed", "canonical_id"), "canonical_id", "left_anti").select("canonical_id", F.when(F.col("o") == 0, "reference").otherwise("citer").alias("origin"))


#: The worth of an edge by its confidence, as quality and as weight.
EDGE_QUALITY = {"high": 1.0, "medium": 0.62, "low": 0.28}
EDGE_WEIGHT = {"high": 1.0, "medium": 0.65, "low": 0.35}


def by_confidence(confidence: Column, values: dict[str, float], other: float) -> Column:
    """The value for a confidence in any spelling."""
    c = F.lower(F.trim(confidence))
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """``column`` scaled to 0..1 over all rows; 0.5 where all are equal. One aggregate row is joined, no global sort."""
    b = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    x = F.when(F.col("_hi") <= F.col("_lo"), 0.5).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return df.crossJoin(F.broadcast(b)).withColumn(out, x).drop("_lo", "_hi")


def edge_quality(n: DataFrame, edges: DataFrame) -> DataFrame:
    """(canonical_id, raw, edge_quality): mean worth of a node's edges (confidence, context), 0.18 if it has none, scaled."""
    v = F.least(F.lit(1.0), by_confidence(F.col("confidence"), EDGE_QUALITY, 0.45) + F.when(F.length(F.trim("context")) > 12, 0.15).otherwise(0.0))
    e = edges.withColumn("v", v)
    ends = e.select(F.col("src").alias("canonical_id"), "v").unionByName(e.select(F.col("dst").alias("canonical_id"), "v"))
    m = n.select("canonical_id").join(ends.groupBy("canonical_id").agg(F.avg("v").alias("raw")), "canonical_id", "left").withColumn("raw", F.coalesce("raw", F.lit(0.18)))
    return min_max(m, "raw", "edge_quality")


def local_connectivity(n: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(canonical_id, connectivity): mean score of the neighbours in either direction, weighted by confidence; 0.45 if none.

    ``scores`` holds (canonical_id, score).
    """
    e = edges.select("src", "dst", by_confidence(F.col("confidence"), EDGE_WEIGHT, 0.5).alias("w"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    # neighbours' scores go to the edges: hot neighbours are salted
    j = salted_join(both.withColumnRenamed("dst", "canonical_id"), scores, "canonical_id", "left", spread="src")
    m = j.groupBy(F.col("src").alias("canonical_id")).agg((F.sum(F.col("w") * F.coalesce("score", F.lit(0.0))) / F.sum("w")).alias("connectivity"))
    return n.select("canonical_id").join(m, "canonical_id", "left").select("canonical_id", F.coalesce("connectivity", F.lit(0.45)).alias("connectivity"))


def hub_suppressed(d: DataFrame, score: str) -> DataFrame:
    """``suppressed``: a score divided by the log of the degree, scaled to 0..1."""
    raw = F.col(score) / F.greatest(F.log1p(F.greatest(F.col("degree"), F.lit(1)).cast("double")), F.lit(1e-6))
    return min_max(d.withColumn("_raw", raw), "_raw", "suppressed").drop("_raw")


def anchor_hops(n: DataFrame, edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(canonical_id, hops): undirected distance to the nearest anchor, 99 if there is no way.

    Breadth first: the frontier is joined with the edges and what it reaches is
    anti-joined with what is known; each round is written, so the lineage stays
    short and rounds end with an empty frontier.
    """
    stage = Stage(n.sparkSession, "hops")
    e = edges.select("src", "dst").distinct()
    both = stage.put(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    known = stage.put(n.select("canonical_id").join(anchors.select(F.col("anchor").alias("canonical_id")).distinct(), "canonical_id", "left_semi").withColumn("hops", F.lit(0)))
    frontier = known
    for h in count(1):
        reached = both.join(frontier.select(F.col("canonical_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("canonical_id")).distinct()
        frontier = stage.put(reached.join(known.select("canonical_id"), "canonical_id", "left_anti").withColumn("hops", F.lit(h)))
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return n.select("canonical_id").join(known, "canonical_id", "left").select("canonical_id", F.coalesce("hops", F.lit(99)).alias("hops"))


#: Edges of one graph that one task ranks; larger graphs are ranked by joins.
KERNEL_EDGES = 2_000_000


def pagerank_kernel(src: np.ndarray, dst: np.ndarray, n: int, damping: float = 0.85, iterations: int = 28) -> np.ndarray:
    """PageRank of n nodes after a fixed number of rounds; parallel edges count, dangling mass is spread evenly."""
    out = np.bincount(src, minlength=n).astype(float)
    r = np.full(n, 1.0 / n)
    for _ in range(iterations):
        per = np.divide(r, out, out=np.zeros(n), where=out > 0)
        r = (1 - damping) / n + damping * (np.bincount(dst, weights=per[src], minlength=n) + r[out == 0].sum() / n)
    return r


def pagerank(edges: DataFrame, graph: str = "query_id", damping: float = 0.85, iterations: int = 28, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(graph, node, rank) of many graphs at once; edges (graph, src, dst) with null ends left out.

    A graph of up to ``kernel_edges`` edges is ranked in one task, larger ones by
    joins, with the same rounds and the same result.
    """
    e = edges.select(graph, "src", "dst").filter("src is not null and dst is not null")
    size = e.groupBy(graph).agg((F.count(F.lit(1)) > kernel_edges).alias("_large"))
    tagged = e.join(size, graph)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        codes, names = pd.factorize(pd.concat([pdf["src"], pdf["dst"]], ignore_index=True))
        m = len(pdf)
        return pd.DataFrame({graph: pdf[graph].iloc[0], "node": names, "rank": pagerank_kernel(codes[:m], codes[m:], len(names), damping, iterations)})

    kind = dict(edges.dtypes)
    small = tagged.filter("not _large").groupBy(graph).applyInPandas(run, f"{graph} {kind[graph]}, node {kind['src']}, rank double")
    large = tagged.filter("_large").drop("_large")
    if large.isEmpty():
        return small
    return small.unionByName(pagerank_by_joins(large, graph, damping, iterations))


def pagerank_by_joins(edges: DataFrame, graph: str, damping: float = 0.85, iterations: int = 28) -> DataFrame:
    """The same by joins: a round is one join of the ranks with the edges and one sum; written every round."""
    stage = Stage(edges.sparkSession, "pagerank")
    e = stage.put(edges.select(graph, "src", "dst"))
    all_ = e.select(graph, F.col("src").alias("node")).unionByName(e.select(graph, F.col("dst").alias("node"))).distinct()
    out = e.groupBy(graph, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out"))
    base = stage.put(all_.join(out, [graph, "node"], "left").join(all_.groupBy(graph).agg(F.count(F.lit(1)).alias("n")), graph))
    r = stage.put(base.withColumn("rank", 1.0 / F.col("n")))
    for _ in range(iterations):
        sent = e.join(r.select(graph, F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("x")), [graph, "src"]).groupBy(graph, F.col("dst").alias("node")).agg(F.sum("x").alias("in"))
        lost = r.groupBy(graph).agg(F.sum(F.when(F.col("out").isNull(), F.col("rank")).otherwise(0.0)).alias("lost"))
        rank = (1 - damping) / F.col("n") + damping * (F.coalesce("in", F.lit(0.0)) + F.col("lost") / F.col("n"))
        nxt = stage.put(base.join(sent, [graph, "node"], "left").join(lost, graph).select(graph, "node", "out", "n", rank.alias("rank")))
        stage.drop(r)
        r = nxt
    return r.select(graph, "node", "rank")


def time_forward_path(edges: DataFrame, n: DataFrame, seeds: DataFrame, length: int = 5) -> DataFrame:
    """(seed, step, canonical_id): from each seed the citing work that follows it most closely in time, step by step.

    Of the citers of the last work whose year is not earlier, the earliest, then the
    smaller id, goes next; unrolled joins, one row per seed and step.
    """
    years = n.select("canonical_id", "year").filter("year between 1900 and 2100")
    e = edges.select(F.col("dst").alias("at"), F.col("src").alias("nxt")).filter("at <> nxt").distinct().join(years.select(F.col("canonical_id").alias("nxt"), F.col("year").alias("ny")), "nxt")
    now = seeds.select("seed", F.col("seed").alias("canonical_id")).join(years, "canonical_id").select("seed", F.lit(1).alias("step"), "canonical_id", "year", F.array("canonical_id").alias("path"))
    out = now
    for s in range(2, length + 1):
        c = now.join(e, F.col("canonical_id") == F.col("at")).filter((F.col("ny") >= F.col("year")) & ~F.array_contains("path", F.col("nxt")))
        best = c.groupBy("seed", "path").agg(F.min(F.struct("ny", "nxt")).alias("b"))
        now = best.select("seed", F.lit(s).alias("step"), F.col("b.nxt").alias("canonical_id"), F.col("b.ny").alias("year"), F.concat("path", F.array("b.nxt")).alias("path"))
        out = out.unionByName(now)
    return out.select("seed", "step", "canonical_id")


def confidence_histogram(edges: DataFrame) -> DataFrame:
    """(confidence, edges): high, medium, low and other in any spelling, also where there are none."""
    c = F.lower(F.trim("confidence"))
    one = edges.agg(*[F.count_if(c == k).alias(k) for k in ("high", "medium", "low")], F.count_if(~F.coalesce(c.isin("high", "medium", "low"), F.lit(False))).alias("other"))
    return one.select(F.expr("stack(4, 'high', high, 'medium', medium, 'low', low, 'other', other) as (confidence, edges)"))


def resolve_edges(edges: DataFrame, n: DataFrame) -> DataFrame:
    """The drawn citations with (src, dst) resolved to nodes; rows whose ends are no nodes left out."""
    a = aliases(n)
    e = edges.withColumn("key", bare_id(F.col("target_paper_id"))).filter(blank_to_null(F.col("target_paper_id")).isNotNull())
    j = salted_join(e, a, "key", "inner", spread="source_paper_id")
    return j.join(n.select(F.col("canonical_id").alias("source_paper_id")), "source_paper_id", "left_semi").select("query_id", F.col("source_paper_id").alias("src"), "dst", "confidence", "context", "context_source", "ref_pos", "created_at")
