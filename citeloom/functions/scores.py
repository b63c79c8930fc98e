"""Scores of papers against a query as column expressions.

Years are compared with an explicit ``as_of`` year.  All scores lie in 0..1
unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic in titles and queries.
STOPWORDS = (
    "the a an of for to in on and or with by as at from into over per via using "
    "paper we our this that these those is are was were be been being it its "
    "method methods approach model models learning data based new using study "
    "analysis work results between among"
).split()
#: Fixed values: (part of a query, domain).
QUERY_DOMAINS = [
    ("bioinform", "biomedical"), ("genomics", "biomedical"), ("protein", "biomedical"), ("clinical", "biomedical"), ("medical", "biomedical"), ("neuroscience", "biomedical"),
    ("physics", "physics"), ("quantum", "physics"), ("chemistry", "physics"), ("law", "law"), ("legal", "law"), ("policy", "social_sciences"), ("economics", "social_sciences"),
    ("psychology", "social_sciences"), ("sociology", "social_sciences"), ("ethics", "ethics"), ("database", "cs"), ("sql", "cs"), ("distributed system", "cs"),
    ("operating system", "cs"), ("compiler", "cs"), ("nlp", "cs"), ("language model", "cs"), ("transformer", "cs"), ("machine learning", "cs"), ("deep learning", "cs"),
    ("neural", "cs"), ("graphics", "cs"), ("rendering", "cs"), ("tessellation", "cs"), ("gpu", "cs"), ("shader", "cs"), ("geometry processing", "cs"), ("mesh", "cs"),
    ("computer vision", "cs"), ("image segmentation", "cs"), ("robotics", "cs"), ("hardware accelerated", "cs"), ("accelerated", "cs"),
]
#: Fixed values: (part of a venue's name, domain), the first that fits counts.
VENUE_DOMAINS = [
    ("emnlp", "cs"), ("acl", "cs"), ("naacl", "cs"), ("eacl", "cs"), ("coling", "cs"), ("iclr", "cs"), ("neurips", "cs"), ("nips", "cs"), ("icml", "cs"), ("cvpr", "cs"),
    ("eccv", "cs"), ("iccv", "cs"), ("aaai", "cs"), ("ijcai", "cs"), ("sigir", "cs"), ("www conference", "cs"), ("the web conference", "cs"), ("kdd", "cs"), ("wsdm", "cs"),
    ("findings of", "cs"), ("machine learning", "cs"), ("arxiv", "cs"), ("bioinformatics", "biomedical"), ("nature medicine", "biomedical"), ("jama", "biomedical"),
    ("lancet", "biomedical"), ("physical review", "physics"),
]
#: Years in which a domain's work loses half its weight.
RECENCY_WINDOWS = {"cs": 1.0, "biomedical": 2.0, "social_sciences": 5.0, "physics": 2.0}
#: Fixed values: (semantic, graph, canonicality) by intent; the first group weighs recency instead of canonicality.
FUSION = {"historical_foundation": (0.20, 0.50, 0.30), "definition": (0.4, 0.2, 0.4), "method_lookup": (0.4, 0.2, 0.4), "survey": (0.4, 0.4, 0.2), "comparison": (0.4, 0.4, 0.2)}
FUSION_OTHER = (0.6, 0.3, 0.1)
RECENCY_INTENTS = ("hardware_system", "technical_method", "recent_progress")


def query_tokens(query: Column, least: int = 3) -> Column:
    """The distinct words of a query that carry a topic, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}_]+"), lambda t: (F.length(t) >= least) & ~t.isin(*STOPWORDS)))


def blob(limit: int = 3200) -> Column:
    """Title and the head of the abstract, as scores read them."""
    return F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("abstract", F.lit("")), 1, limit)))


def share_in(words: Column, text: Column, none: float) -> Column:
    """The share of ``words`` found in ``text`` as parts; ``none`` without words or text."""
    hits = F.size(F.filter(words, lambda t: F.instr(text, t) > 0))
    return F.when((F.size(words) > 0) & (F.trim(text) != ""), hits / F.size(words)).otherwise(none)


def vocabulary_coherence(query: Column) -> Column:
    return share_in(query_tokens(query), blob(), 0.45)


def lexical_similarity(query: Column) -> Column:
    """The share of the query's words in the title."""
    return share_in(query_tokens(query), F.lower(F.coalesce("title", F.lit(""))), 0.0)


def phrase_overlap(query: Column, text: Column, most: int = 8) -> Column:
    """1 if the text holds the query; else 0.55 + 0.12 per word of the longest run of two to ``most`` words it holds, up to 1; 0 if none."""
    q, t = F.trim(F.lower(query)), F.lower(text)
    w = F.filter(F.split(q, r"\s+"), lambda x: x != "")

    def runs(n: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.exists(starts, lambda i: (F.length(F.array_join(F.slice(w, i, n), " ")) > 6) & (F.instr(t, F.array_join(F.slice(w, i, n), " ")) > 0))

    longest = F.array_max(F.filter(F.sequence(F.lit(2), F.lit(most)), runs))
    return F.when((q == "") | t.isNull(), 0.0).when(F.instr(t, q) > 0, 1.0).when(longest.isNull(), 0.0).otherwise(F.least(F.lit(1.0), 0.55 + 0.12 * longest))


def recency_alignment(year: Column, as_of: int) -> Column:
    age = F.greatest(F.lit(as_of) - year, F.lit(0))
    return F.when(year.isNull(), 0.55).when(age <= 2, 1.0).when(age <= 5, 0.82).when(age <= 10, 0.58).when(age <= 18, 0.35).otherwise(0.18)


def recency_penalty(year: Column, as_of: int) -> Column:
    age = F.greatest(F.lit(as_of) - year, F.lit(0))
    return F.when(year.isNull(), 0.04).when(age <= 4, 0.0).when(age <= 10, 0.06).when(age <= 18, 0.10).otherwise(0.14)


def recency_decay(domain: Column, year: Column, as_of: int) -> Column:
    d = F.lower(domain)
    window = F.lit(3.0)
    for k, v in RECENCY_WINDOWS.items():
        window = F.when(d == k, v).otherwise(window)
    return F.when(year.isNull(), 0.7).otherwise(1.0 / (1.0 + F.greatest(F.lit(as_of) - year, F.lit(0)) / window))


def era_coherence(year: Column, as_of: int, modern: int = 2018) -> Column:
    age = F.lit(as_of) - year
    return F.when(year.isNull(), 0.55).when(year >= modern, 1.0).when(age <= 25, 0.72).when(age <= 35, 0.5).otherwise(0.35)


def hop_bonus(hops: Column) -> Column:
    return F.when(hops >= 98, 0.0).when(hops <= 1, 1.0).when(hops == 2, 0.75).when(hops == 3, 0.45).otherwise(0.10)


def anchor_consistency(hops: Column) -> Column:
    return F.when(hops.isNull(), 0.45).when(hops >= 98, 0.25).when(hops <= 1, 1.0).when(hops == 2, 0.82).when(hops == 3, 0.62).when(hops <= 5, 0.45).otherwise(0.28)


def drift_penalty(hops: Column, cap: int = 10) -> Column:
    return F.when(hops >= 98, 0.0).otherwise(F.least(F.greatest(hops, F.lit(0)), F.lit(cap)) / float(cap))


def domains_of_query(query: Column) -> Column:
    """The distinct domains a query hints at, sorted."""
    q = F.lower(query)
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.instr(q, F.lit(k)) > 0, F.lit(d)) for k, d in QUERY_DOMAINS]))))


def domain_of_venue(venue: Column) -> Column:
    v = F.lower(F.trim(venue))
    return F.coalesce(*[F.when(F.instr(v, F.lit(k)) > 0, F.lit(d)) for k, d in VENUE_DOMAINS])


def domain_multiplier(domain: Column, wanted: Column) -> Column:
    d = F.lower(F.trim(F.coalesce(domain, F.lit(""))))
    return F.when(F.size(wanted) == 0, 1.0).when(d == "", 0.82).when(F.array_contains(wanted, d), 1.0).otherwise(0.58)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def canonicality(query: Column, inbound: Column, survey_context: Column, boosted: Column) -> Column:
    """How much a paper is the source of what the query names, by title and citations."""
    q, t = F.trim(F.lower(query)), F.lower(F.trim(F.coalesce("title", F.lit(""))))
    w = F.filter(F.split(F.regexp_replace(q, ",", " "), r"\s+"), lambda x: F.length(x) > 2)
    title = F.when(q == "", 0.0).when(F.instr(t, q) > 0, 0.6).when(F.size(w) > 0, 0.45 * F.size(F.filter(w, lambda x: F.instr(t, x) > 0)) / F.size(w)).otherwise(0.0)
    base = title + F.least(inbound / 100.0, F.lit(0.3)) + F.when(survey_context, 0.2).otherwise(0.0)
    return clamp(base * F.when(boosted, 1.5).otherwise(1.0))


def query_canonicality(base: Column, hops: Column, semantic: Column, vocabulary: Column, year: Column, inbound: Column, penalty: Column, as_of: int) -> Column:
    age = F.when(year.isNull(), 12).otherwise(F.greatest(F.lit(as_of) - year, F.lit(0)))
    c = 0.32 * base + 0.28 * hop_bonus(hops) + 0.22 * clamp(semantic) + 0.18 * clamp(vocabulary) - penalty
    c = c * F.when((inbound > 500) & (age > 10), 0.85).otherwise(1.0)
    return clamp(c + F.when(year.isNotNull() & (F.lit(as_of) - year <= 7) & (semantic >= 0.6), 0.10).otherwise(0.0))


def fused(semantic: Column, graph: Column, canonical: Column, recency: Column, intent: Column, boost: Column | None = None) -> Column:
    """The fused score of one intent."""
    boost = F.lit(False) if boost is None else boost
    s, g, r = clamp(semantic), clamp(graph), clamp(recency)
    triple = F.when(boost, 0.40 * s + 0.50 * r + 0.10 * g).otherwise(0.45 * s + 0.35 * r + 0.20 * g)
    w = FUSION_OTHER
    out = w[0] * semantic + w[1] * graph + w[2] * canonical
    for k, w in FUSION.items():
        out = F.when(intent == k, w[0] * semantic + w[1] * graph + w[2] * canonical).otherwise(out)
    return F.when(intent.isin(*RECENCY_INTENTS), triple).otherwise(out)


def final_score(semantic: Column, graph: Column, canonical: Column, recency: Column, intent: Column, distribution: Column) -> Column:
    """Fusion over a map of intents where none holds 0.52 of the mass, else by the main intent; old work is cut for recency intents."""
    entries = F.filter(F.map_entries(distribution), lambda e: e["value"] >= 0.03)
    num = F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["value"] * fused(semantic, graph, canonical, recency, e["key"]))
    den = F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["value"])
    mixed = F.array_max(F.map_values(distribution)) < 0.52
    one = fused(semantic, graph, canonical, recency, intent)
    out = F.when(F.coalesce(mixed, F.lit(False)) & (den > 0), num / den).otherwise(one)
    return out * F.when(intent.isin(*RECENCY_INTENTS) & (recency < 0.25), 0.6).otherwise(1.0)


def controlled(base: Column, connectivity: Column, drift: Column, domain: Column, gamma: float = 0.09, delta: float = 0.12) -> Column:
    return F.greatest(F.lit(0.0), (base + gamma * connectivity - delta * drift) * domain)


def verified(similarity: Column, graph: Column, connectivity: Column, drift: Column, alpha: float = 0.45, beta: float = 0.32, gamma: float = 0.15, delta: float = 0.12) -> Column:
    return F.greatest(F.lit(0.0), alpha * similarity + beta * graph + gamma * connectivity - delta * drift)


def coherence(semantic: Column, lexical: Column, vocabulary: Column, venue: Column, anchor: Column, era: Column, domain: Column) -> Column:
    return clamp(0.28 * semantic + 0.22 * lexical + 0.14 * vocabulary + 0.12 * venue + 0.10 * anchor + 0.08 * era + 0.06 * F.least(F.lit(1.0), domain))


def entropy(distribution: Column) -> Column:
    """Shannon entropy of a map's values in nats."""
    v = F.filter(F.map_values(distribution), lambda x: x > 0)
    s = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(v, F.lit(0.0), lambda a, x: a - x / s * F.log(x / s + 1e-15))
