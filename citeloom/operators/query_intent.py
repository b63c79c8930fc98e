"""What a free-text query asks for: cues, intents, their distribution, and ambiguity.

Cue lists are small fixed dimension tables, turned into literal arrays, so a table
of queries of any size is classified in one scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cues by intent; a cue counts wherever it stands in the query.
CUES = {
    "definition": ("what is", "what are", "define", "definition", "meaning of", "explain", "introduction to", "tell me about"),
    "survey": ("survey", "literature review", "systematic review", "review of", "overview of", "state of the art"),
    "comparison": (" vs ", " versus ", "compare ", "comparison", "difference between", "differences between", "contrasted", "benchmark"),
    "recent_progress": ("latest", "recent", "new ", "2024", "2025", "2026", "state of the art", "sota", "current", "this year", "modern gpu", "neural rendering"),
    "historical_foundation": ("history of", "historical", "seminal", "foundational", "original formulation", "classic paper", "pioneering", "first introduced"),
    "hardware_system": ("gpu", "hardware", "accelerat", "tessellation", "shader", "cuda", "rendering pipeline", "graphics hardware", "graphics", "real-time", "real time", "pipeline", "fpga", "asic", "simd", "parallel ", "distributed system", "runtime", "throughput", "latency"),
    "technical_method": ("implementation", "engineering", "algorithm", "method", "methods", "optimization", "framework", "model", "benchmark", "complexity", "architecture", "system design", "deployment"),
}
#: Features of which two make a hardware query.
HARDWARE_FEATURES = ("gpu", "shader", "tessellation", "cuda", "pipeline", "acceleration", "accelerated", "parallel", "graphics")
#: Prior mass and mass per cue of each intent.
PRIOR = {"hardware_system": 0.08, "technical_method": 0.08, "historical_foundation": 0.06, "recent_progress": 0.08, "survey": 0.05, "comparison": 0.05, "definition": 0.05, "method_lookup": 0.05, "exploratory": 0.12}
PER_CUE = {"hardware_system": 0.22, "technical_method": 0.18, "historical_foundation": 0.2, "recent_progress": 0.16, "survey": 0.18, "comparison": 0.2, "definition": 0.15}
#: Words that make a query less of a name.
FILLERS = ("the", "a", "an", "for", "to", "of", "in", "on", "and", "or", "with", "using", "via")
#: Fixed values: (id, patterns, whole-word patterns, exclusions, ambiguity), the first that fits counts.
REGISTRY = (
    ("direct_preference_optimization", ("direct preference optimization", "directed preference optimization", "dpo ", " dpo"), ("dpo",), (), 0.72),
    ("transformer_nlp", ("transformer",), (), ("power transformer", "electrical transformer", "fault diagnosis", "substation", "grid", "insulation", "hv "), 0.78),
    ("visual_debugging", ("visual debugging", "software visualization debugging", "program visualization"), (), (), 0.68),
    ("graph_neural_networks", ("graph neural network", "graph neural networks", "graph convolutional", "graphsage", "graph attention network"), ("gnn",), (), 0.62),
    ("rlhf_alignment", ("rlhf", "reinforcement learning from human feedback", "reward modeling", "constitutional ai"), (), (), 0.65),
)
#: Older names of intents.
OLD_NAMES = {"canonical_lookup": "method_lookup", "survey_mode": "survey", "exploratory_mode": "exploratory"}


def _q(query: Column) -> Column:
    return F.lower(F.trim(F.coalesce(query, F.lit(""))))


def hits(query: Column, cues: tuple[str, ...]) -> Column:
    """How many of the cues the query holds."""
    q = _q(query)
    return F.aggregate(F.array(*[F.lit(c) for c in cues]), F.lit(0), lambda n, c: n + F.when(F.instr(q, c) > 0, 1).otherwise(0))


def words(query: Column) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(query, F.lit(""))), r"\s+"), lambda w: w != "")


def is_comparison(query: Column) -> Column:
    return (hits(query, CUES["comparison"]) > 0) | _q(query).rlike(r"\b(and|or)\b.*\b(and|or)\b")


def hardware_features(query: Column) -> Column:
    plain = tuple(f for f in HARDWARE_FEATURES if f != "parallel")
    return hits(query, plain) + F.when(_q(query).rlike(r"\bparallel\b"), 1).otherwise(0)


def is_hardware(query: Column) -> Column:
    return (hits(query, CUES["hardware_system"]) > 0) | (hardware_features(query) >= 2)


def is_entity(query: Column) -> Column:
    """Short and noun-like, as the name of one work or method is."""
    w = words(query)
    n = F.size(w)
    filler = F.size(F.filter(w, lambda x: F.lower(x).isin(*FILLERS)))
    return F.when((n == 0) | (n > 14), False).when((n <= 1) & (F.length(F.trim(query)) <= 40), True).when(_q(query).endswith("?"), n <= 10).otherwise((n <= 10) & (filler / F.greatest(n, F.lit(1)) < 0.45))


def is_method_name(query: Column) -> Column:
    w = words(query)
    n = F.size(w)
    capital = F.size(F.filter(w, lambda x: F.substring(x, 1, 1).rlike(r"^\p{Lu}")))
    plain = ~is_comparison(query) & (hits(query, CUES["definition"]) == 0) & (hits(query, CUES["survey"]) == 0)
    short = (n <= 6) & (F.size(F.filter(w, lambda x: F.length(x) > 40)) == 0)
    return (n >= 2) & (n <= 12) & plain & ((capital >= F.greatest(F.lit(2), F.floor(n / 2))) | short)


def classify(query: Column) -> Column:
    """struct<intent, confidence>: the first rule that fits."""
    s = lambda i, c: F.struct(F.lit(i).alias("intent"), F.lit(c).alias("confidence"))
    has = lambda k: hits(query, CUES[k]) > 0
    e = is_entity(query)
    return (
        F.when(is_comparison(query), s("comparison", 0.72))
        .when(hardware_features(query) >= 2, s("hardware_system", 0.9))
        .when(has("survey"), s("survey", 0.7))
        .when(has("recent_progress") & e, s("recent_progress", 0.68))
        .when(has("historical_foundation") & e, s("historical_foundation", 0.7))
        .when(is_hardware(query), s("hardware_system", 0.74))
        .when(has("technical_method") & e, s("technical_method", 0.66))
        .when(has("definition") & e, s("definition", 0.8))
        .when(is_method_name(query) & e, s("method_lookup", 0.72))
        .otherwise(s("exploratory", 0.6))
    )


def masses(query: Column) -> dict[str, Column]:
    """The mass of each intent before normalization."""
    out = {}
    for k, p in PRIOR.items():
        m = F.lit(p)
        if k in PER_CUE:
            cues = tuple(c for c in CUES[k] if k != "technical_method" or c not in CUES["hardware_system"])
            m = m + hits(query, cues) * PER_CUE[k]
        elif k == "method_lookup":
            m = m + F.when(is_method_name(query), 0.25).otherwise(0.0)
        out[k] = m
    return out


def distribution(query: Column) -> Column:
    """map<intent, share>, summing to 1."""
    m = masses(query)
    total = sum(m.values(), F.lit(0.0))
    return F.create_map(*[x for k, v in m.items() for x in (F.lit(k), v / total)])


#: Fixed value: the share that a query with two features of hardware gives its intent.
SPIKE = 0.92


def spiked(shares: Column, intent: str, spike: float = SPIKE) -> Column:
    """A distribution that leaves all intents but one an equal part of the rest."""
    keys = F.array_union(F.map_keys(shares), F.array(F.lit(intent)))
    rest = (1.0 - spike) / (F.size(keys) - 1)
    values = F.transform(keys, lambda k: F.round(F.when(k == intent, F.lit(spike)).otherwise(rest), 4))
    return F.when(F.size(keys) <= 1, F.create_map(F.lit(intent), F.lit(1.0))).otherwise(F.map_from_arrays(keys, values))


def classified(query: Column) -> Column:
    """struct<intent, confidence, distribution, recency_boost>: two features of hardware sharpen the distribution and boost recency."""
    strong = (hardware_features(query) >= 2) & ~is_comparison(query)
    c = classify(query)
    boost = (hardware_features(query) >= 2) & (c["intent"] == "hardware_system")
    return F.struct(c["intent"].alias("intent"), c["confidence"].alias("confidence"), F.when(strong, spiked(distribution(query), "hardware_system")).otherwise(distribution(query)).alias("distribution"), boost.alias("recency_boost"))


def registry_entry(query: Column) -> Column:
    """The id of the first registry entry that the query matches, else null."""
    q = _q(query)
    out = F.lit(None).cast("string")
    for name, patterns, whole, excluded, _ in reversed(REGISTRY):
        fits = (hits(query, patterns) > 0) | (q.rlike("|".join(rf"\b{w}\b" for w in whole)) if whole else F.lit(False))
        if excluded:
            fits = fits & (hits(query, excluded) == 0)
        out = F.when(fits, name).otherwise(out)
    return out


def ambiguity(query: Column) -> Column:
    n = F.size(words(query))
    base = F.lit(None).cast("double")
    entry = registry_entry(query)
    for name, _, _, _, a in REGISTRY:
        base = F.when(entry == name, a).otherwise(base)
    known = F.least(F.lit(1.0), base + F.when(n <= 2, 0.12).otherwise(0.0) + F.when(n == 1, 0.08).otherwise(0.0))
    return F.when(base.isNull(), F.when(n <= 2, 0.45).otherwise(0.25)).otherwise(known)


def current_name(intent: Column) -> Column:
    out = intent
    for k, v in OLD_NAMES.items():
        out = F.when(intent == k, v).otherwise(out)
    return out
