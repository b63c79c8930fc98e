from __future__ import annotations

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.functions import extract as X
from citeloom.functions import scores as S
from citeloom.functions.ids import bare_id, strip_ws
from citeloom.operators import evaluation, feedback, graph, nested, normalize, orphans, query_intent, ranking, resolve
from citeloom.operators.skew import salted_join
from citeloom.sources import landing, reports
from citeloom.staging import Stage
from citeloom.streaming import feedback as stream
from tests.conftest import paper


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    "given, want",
    [
        (" 10.99/ABC\n", "10.99/abc"), ("https://doi.example/10.99901/x.2010.5", "10.99901/x.2010.5"), ("http://dx.doi.example/10.99/a/b", "10.99/a/b"), ("DOI: 10.99/q", "10.99/q"),
        ("arXiv:2401.12345v3", "2401.12345"), ("https://arxiv.example/abs/1612.82449", "1612.82449"), ("http://arxiv.example/abs/math/0309136v2", "math/0309136"),
        ("http://openalex.example/works/W9", "w9"), ("OpenAlex:W9", "w9"), ("http://s2.example/00ff", "00ff"), ("pmid:12", "pmid:12"), ("  \t", None), ("", None), (None, None), ("doi:", None),
    ],
)
def test_bare_id(spark, given, want):
    assert one(spark, bare_id, given) == want


def test_strip_ws_takes_any_white_space(spark):
    assert one(spark, strip_ws, "  a b \n") == "a b"


def test_salted_join_equals_plain_join(spark):
    rnd = random.Random(1)
    left = spark.createDataFrame([(rnd.choice(["hot"] * 6 + ["a", "b", None]), i) for i in range(400)], "k string, v int")
    right = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "k string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows_n(salted_join(left, right, "k", how, spread="v", hot_rows=20)) == rows_n(left.join(right, "k", how))


def rows_n(df):
    return sorted(tuple("" if x is None else str(x) for x in r) for r in df.select(*sorted(df.columns)).collect())


def test_orphans(spark):
    parents = spark.createDataFrame([("doi:10.1234/a", "10.1234/A", None)], "canonical_id string, doi string, arxiv_id string")
    edges = spark.createDataFrame(
        [("s", "https://doi.example/10.1234/a", dt.datetime(2024, 1, 5)), ("s", "10.1234/b", dt.datetime(2024, 1, 5)), ("s", "10.1234/b", dt.datetime(2024, 1, 9)), ("s", " ", dt.datetime(2024, 1, 9)), (None, "doi: ", None)],
        "source_paper_id string, target_paper_id string, created_at timestamp_ntz",
    )
    refs = orphans.edge_references(edges)
    found = orphans.orphan_references(refs, orphans.parent_keys(parents, ["canonical_id", "doi", "arxiv_id"]))
    assert rows_n(found) == sorted([("2024-01", "10.1234/b", "s", "edges"), ("", "doi: ", "", "edges")])
    report = orphans.orphan_counts(found, refs)
    assert rows_n(report.select("period", "refs", "orphans")) == [("1", "", "1"), ("1", "2024-01", "2")]
    empty = refs.limit(0)
    assert orphans.orphan_references(empty, orphans.parent_keys(parents, ["doi"])).count() == 0


def brute_children(text):
    """The rows of one JSON text, written without Spark."""
    try:
        v = json.loads(text)
        v = json.loads(v) if isinstance(v, str) else v
    except (TypeError, ValueError):
        return None
    v = v[0] if isinstance(v, list) and v else v
    if not isinstance(v, dict):
        return None
    for w in (v.get("message"), (v.get("results") or [None])[0] if isinstance(v.get("results"), list) else None, v.get("data")):
        if isinstance(w, dict):
            v = w
            break

    def kids(x, keys):
        if not isinstance(x, dict):
            return []
        for k in keys:
            if x.get(k) is not None:
                return x[k] if isinstance(x[k], list) else [x[k]]
        return []

    out = []
    for name, keys, sub, subkeys in (("author", ("authorships", "author", "authors"), "affiliation", ("institutions", "affiliation", "affiliations")), ("reference", ("referenced_works", "reference", "references"), None, ()), ("funder", ("grants", "funder"), "award", ("award_ids", "award"))):
        for i, x in enumerate(kids(v, keys)):
            if x is not None:
                out.append((name, -1, i))
                out += [(sub, i, j) for j, y in enumerate(kids(x, subkeys)) if sub and y is not None]
    return sorted(out)


PAYLOADS = [
    '{"authors": ["A", null, {"name": "B", "affiliations": ["u", null, "v"]}], "references": {"paperId": "x"}}',
    '{"message": {"author": {"given": "A", "affiliation": [{"name": "u"}]}, "funder": [{"name": "f", "award": "A-1"}, null, {"award": ["a", "b"]}]}}',
    '[{"authorships": [{"institutions": {"id": 1}}]}]',
    json.dumps(json.dumps({"data": {"authors": [{"affiliations": []}]}})),
    "{}", "null", "", None, "{broken", '"text"', "[]", "[1]", "12", '{"results": []}', '{"authors": "single"}', '{"author": null, "authors": [1, 2]}',
]


def test_nested_children_equal_brute_force(spark):
    df = spark.createDataFrame([(f"k{i}", p, 1) for i, p in enumerate(PAYLOADS)], "k string, body string, at int")
    got = {}
    for k, c, p, n in nested.child_rows(nested.newest_labels(df, ["k"], "body", "at"), ["k"]).collect():
        got.setdefault(k, []).append((c, p, n))
    for i, p in enumerate(PAYLOADS):
        assert sorted(got.get(f"k{i}", [])) == (brute_children(p) or []), p


def test_newest_object_counts(spark):
    df = spark.createDataFrame([("k", '{"authors": ["a", "b"]}', 1), ("k", '{"authors": ["a"]}', 2), ("k", "broken", 3), (None, '{"authors": ["n"]}', None)], "k string, body string, at int")
    assert rows_n(nested.child_rows(nested.newest_labels(df, ["k"], "body", "at"), ["k"])) == [("author", "0", "", "-1"), ("author", "0", "k", "-1")]


def test_tables_keep_parent_links(spark):
    df = spark.createDataFrame([("k", PAYLOADS[1], 1)], "k string, body string, at int")
    t = nested.as_tables(nested.newest_labels(df, ["k"], "body", "at", values=True))
    assert [(r.dewey, r.parent) for r in t["funder/award"].orderBy("dewey").collect()] == [([0, 0], [0]), ([2, 0], [2]), ([2, 1], [2])]


def test_all_nodes_of_any_json(spark):
    df = spark.createDataFrame([(1, '{"a": [{"b": 1}, 2]}'), (2, "no json")], "k int, t string")
    got = [(tuple(r.dewey), r.path, r.value) for r in nested.all_nodes(df, ["k"], "t", 4).orderBy("dewey").collect()]
    assert got == [((0,), "$.a", '[{"b":1},2]'), ((0, 0), "$.a[]", '{"b":1}'), ((0, 0, 0), "$.a[].b", "1"), ((0, 1), "$.a[]", "2")]


def tiny_graph(papers):
    return papers([
        paper("up:1", 1, title="Root", references=["hub:1", "10.1234/r2"]), paper("hub:1", 2, title="Hub", references=["nowhere"], year=2000),
        paper("r:2", 3, title="Second", doi="10.1234/R2", abstract="about a root"), paper("cand:1", 4, title="Candidate", references=["hub:1", "r:2", "r:2", None], year=2005, abstract="The hub itself"),
    ])


def test_reference_resolution_and_degrees(spark, papers):
    n = graph.nodes(tiny_graph(papers), "title", "doi", "arxiv_id", "openalex_id", "semantic_scholar_id", "references", "abstract", "year")
    e = graph.resolve_references(n)
    assert rows(e.select("src", "dst")) == [("cand:1", "hub:1"), ("cand:1", "r:2"), ("cand:1", "r:2"), ("up:1", "hub:1"), ("up:1", "r:2")]
    assert {r.canonical_id: r.degree for r in graph.degrees(n, e).collect()} == {"up:1": 2, "hub:1": 2, "r:2": 3, "cand:1": 3}
    assert rows(graph.coupling(e, 2).select("a", "b", "shared")) == [("cand:1", "up:1", 2)]
    assert rows(graph.cocitation(e, 2)) == [("hub:1", "r:2", 2)]
    anchors = spark.createDataFrame([("up:1",)], "anchor string")
    s = {r.canonical_id: r for r in graph.relation_scores(n, e, anchors).collect()}
    assert s["cand:1"].max_coupling == 2 and s["cand:1"].score == pytest.approx(0.6)
    assert rows(graph.anchor_hops(n, e, anchors)) == [("cand:1", 2), ("hub:1", 1), ("r:2", 1), ("up:1", 0)]
    conf = {(r.src, r.dst): r.confidence for r in graph.edge_context(e.select("src", "dst"), n).collect()}
    assert conf["cand:1", "hub:1"] == "medium" and conf["up:1", "hub:1"] == "low"


def test_repeated_edges_change_degrees_not_couplings(spark):
    e = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("b", "y")], "src string, dst string")
    twice = e.unionByName(e)
    assert rows(graph.coupling(e, 2)) == rows(graph.coupling(twice, 2)) == [("a", "b", 2)]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_coupling_equals_brute_force(spark, k):
    rnd = random.Random(k)
    refs = {f"p{i}": {f"r{int(rnd.paretovariate(0.8)) % 25}" for _ in range(rnd.randint(1, 9))} for i in range(40)}
    e = spark.createDataFrame([(p, r) for p, rs in refs.items() for r in rs], "src string, dst string")
    want = sorted((a, b, len(refs[a] & refs[b])) for a in refs for b in refs if a < b and len(refs[a] & refs[b]) >= k)
    assert rows(graph.coupling(e, k)) == want


def brute_pagerank(edges, damping=0.85, rounds=28):
    nodes = sorted({x for e in edges for x in e})
    r = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        out = {x: sum(1 for s, _ in edges if s == x) for x in nodes}
        lost = sum(r[x] for x in nodes if not out[x])
        nxt = dict.fromkeys(nodes, (1 - damping) / len(nodes) + damping * lost / len(nodes))
        for s, t in edges:
            nxt[t] += damping * r[s] / out[s]
        r = nxt
    return r


def test_pagerank_both_ways(spark):
    edges = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("c", "e")]
    df = spark.createDataFrame([("q1", s, t) for s, t in edges] + [("q2", "x", "y")], "query_id string, src string, dst string")
    want = brute_pagerank(edges)
    got = {(r.query_id, r.node): r["rank"] for r in graph.pagerank(df).collect()}
    assert {k: got["q1", k] for k in want} == pytest.approx(want)
    few = graph.pagerank_by_joins(df.filter("query_id = 'q1'"), "query_id", iterations=6)
    assert {r.node: r["rank"] for r in few.collect()} == pytest.approx(brute_pagerank(edges, rounds=6))


def test_kernel_sums_to_one():
    r = graph.pagerank_kernel(np.array([0, 1]), np.array([1, 2]), 4)
    assert r.sum() == pytest.approx(1)


def test_min_max_of_equal_values_is_half(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 3.0)], "id int, v double")
    assert [r.x for r in graph.min_max(df, "v", "x").collect()] == [0.5, 0.5]


def test_ranks_over_ranges(spark):
    df = spark.createDataFrame([(f"p{i:03d}", float(i % 7)) for i in range(200)] + [("null", None)], "canonical_id string, s double")
    got = [r.canonical_id for r in ranking.ranked(df, "s").orderBy("rank").collect()]
    want = [r.canonical_id for r in df.orderBy(F.desc_nulls_last("s"), "canonical_id").collect()]
    assert got == want


def test_diversity_penalizes_repeats(spark):
    df = spark.createDataFrame([("a", "Graph neural networks survey", 1.0), ("b", "Graph neural networks survey again", 0.99), ("c", "", 0.5)], "canonical_id string, title string, r double")
    got = {r.canonical_id: r for r in ranking.diversity(df, "r").collect()}
    assert got["a"].repeat == 0 and got["b"].repeat == 1 and got["b"].diverse == pytest.approx(0.8712) and got["c"].topic == "unknown"


def test_intents(spark):
    q = ["survey of retrieval", "gpu shader pipelines", "BERT vs GPT", "what is attention", "history of deep learning", "Direct Preference Optimization", "", None]
    df = spark.createDataFrame([(x,) for x in q], "q string").select("q", query_intent.classify(F.col("q"))["intent"].alias("i"), query_intent.registry_entry(F.col("q")).alias("e"))
    got = {r.q: r.i for r in df.collect()}
    assert got["survey of retrieval"] == "survey" and got["gpu shader pipelines"] == "hardware_system" and got["BERT vs GPT"] == "comparison"
    assert got["what is attention"] == "definition" and got["history of deep learning"] == "historical_foundation" and got[""] == "exploratory"
    assert {r.q: r.e for r in df.collect()}["Direct Preference Optimization"] == "direct_preference_optimization"
    total = spark.range(1).select(F.aggregate(F.map_values(query_intent.distribution(F.lit("survey of gpus"))), F.lit(0.0), lambda a, x: a + x)).first()[0]
    assert total == pytest.approx(1)


def test_scores_handle_nulls(spark, papers):
    x = papers([paper("a", title="Garbage collection in virtual machines", year=2025), paper("b")])
    r = {r[0]: r for r in x.select("canonical_id", S.phrase_overlap(F.lit("garbage collection"), F.col("title")), S.vocabulary_coherence(F.lit("garbage collection")), S.recency_alignment(F.col("year"), 2026)).collect()}
    assert tuple(r["a"])[1:] == (1.0, 1.0, 1.0) and tuple(r["b"])[1:] == (0.0, 0.45, 0.55)


def test_final_score_mixes_uncertain_intents(spark):
    sharp = F.create_map(F.lit("survey"), F.lit(0.95), F.lit("definition"), F.lit(0.05))
    flat = F.create_map(F.lit("survey"), F.lit(0.5), F.lit("definition"), F.lit(0.5))
    args = [F.lit(x) for x in (0.8, 0.2, 0.1, 0.5)]
    a, b = spark.range(1).select(S.final_score(*args, F.lit("survey"), sharp), S.final_score(*args, F.lit("survey"), flat)).first()
    assert a == pytest.approx(0.42) and b == pytest.approx((0.42 + 0.40) / 2)


def test_extraction(spark):
    t = "Header 10.1234/HEAD.1\n" + "x " * 900 + "\nsee 10.1234/tail.2 and arXiv:2401.12345v2"
    assert one(spark, lambda c: X.tail_first(c, X.DOI), t) == "10.1234/tail.2"
    assert one(spark, lambda c: X.tail_first(c, X.ARXIV), "arXiv:2401.12345 x") == "2401.12345"
    assert one(spark, X.all_dois, t) == ["10.1234/head.1", "10.1234/tail.2"]
    assert one(spark, X.strip_tags, "<jats:p> a  <b>b</b></jats:p>") == "a b"
    assert one(spark, X.guess_title, "Proceedings of the X\nshort\nA long and plausible title line\nAnother one, longer than the one before") == "Another one, longer than the one before"
    assert one(spark, X.header, "body text\nReferences\n[1]") == "body text\n"


def test_normalizers(spark):
    raw = [
        ("crossref", "1", '{"message": {"DOI": "10.1234/A", "title": ["", "T"], "author": [{"given": "Ann", "family": "Lee"}], "reference": [{"DOI": "10.1/B"}, {"unstructured": "x"}], "published-print": {"date-parts": [[2020, 1]]}, "abstract": "<p>hi</p>"}}'),
        ("openalex", "2", '{"id": "https://openalex.example/W1", "title": "O", "publication_year": "2019", "authorships": [{"author": {"display_name": "B"}}, null], "referenced_works": ["https://x/W2"], "abstract_inverted_index": {"b": [1], "a": [0, 2]}}'),
        ("arxiv", "3", '{"id": "2401.00001", "title": " X ", "authors": ["C"], "summary": "s"}'),
        ("semantic_scholar", "4", '{"data": {"paperId": "ff", "title": null, "year": 2018, "references": [{"paperId": null}, {"paperId": "ee"}], "externalIds": {"DOI": null}}}'),
        ("arxiv", "5", "broken"),
    ]
    df = normalize.normalize(spark.createDataFrame(raw, "source string, source_id string, payload string"), "source", "source_id", "payload")
    r = {x.source_id: x for x in df.collect()}
    assert set(r) == {"1", "2", "3", "4"}
    assert (r["1"].canonical_id, r["1"].title, r["1"].year, r["1"].authors, r["1"].references, r["1"].abstract) == ("doi:10.1234/a", "T", 2020, ["Ann Lee"], ["10.1/b"], "hi")
    assert (r["2"].canonical_id, r["2"].year, r["2"].authors, r["2"].abstract) == ("openalex:W1", 2019, ["B"], "a b a")
    assert (r["3"].title, r["3"].year, r["3"].venue, r["3"].doi) == ("X", None, "arXiv", "10.48550/arxiv.2401.00001")
    assert (r["4"].canonical_id, r["4"].title, r["4"].references) == ("s2:ff", "untitled", ["ee"])
    assert [one(spark, normalize.arxiv_year, x) for x in ("2401.00001", "9912.12345", "math/0309136", "zz")] == [2024, 1999, 2003, None]


def test_merging(spark, papers):
    p = papers([
        paper("openalex:W1", 1, title="From openalex", doi="10.1234/x", abstract="an abstract", references=["b"], provenance=[("openalex", "W1", None, None, None)]),
        paper("doi:10.1234/x", 2, title="From crossref", doi="https://doi.example/10.1234/X", references=["a", None], provenance=[("crossref", "x", None, None, None)]),
        paper("arxiv:1", 3, title="Alone"), paper("s2:1", 4, title="Hinted"), paper("s2:2", 5, title="Also"),
    ])
    f = spark.createDataFrame([("merge_hint", "s2:2 ", "s2:1", True), ("bad_citation", "arxiv:1", "s2:1", False), ("merge_hint", "arxiv:1", "s2:1", True)], "event_type string, left_id string, right_id string, accepted boolean")
    n = graph.nodes(p, "title", "doi", "arxiv_id", "semantic_scholar_id", "openalex_id", "abstract", "venue", "references", "provenance")
    r = {x.record_id: x for x in resolve.merged_records(n, f).collect()}
    assert set(r) == {"doi:10.1234/x", "arxiv:1", "s2:1"}
    assert (r["doi:10.1234/x"].title, r["doi:10.1234/x"].abstract, r["doi:10.1234/x"].references) == ("From crossref", "an abstract", ["a", "b"])
    assert r["s2:1"].members == 2


def test_rank_metrics(spark):
    ranked = spark.createDataFrame([("q", x, i) for i, x in enumerate("abcdef", 1)] + [("e", "a", 1)], "query_id string, item string, rank int")
    rel = spark.createDataFrame([("q", "a"), ("q", "x")], "query_id string, item string")
    r = {x.query_id: x for x in evaluation.rank_metrics(ranked, rel).collect()}
    assert (r["q"].p_at_5, r["q"].reciprocal_rank, r["q"].recall_at_10) == (0.2, 1.0, 0.5)
    assert (r["e"].p_at_5, r["e"].reciprocal_rank, r["e"].recall_at_10) == (0.0, 0.0, 0.0)


def test_cosine(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "vec_id int, embedding array<float>")
    assert rows(evaluation.cosine_top_k(v, v.filter("vec_id = 0"), 1)) == [(0, 1, 1.0, 1)]


def test_title_ratio(spark):
    df = spark.createDataFrame([("abcd", "ABCD"), ("abcd", "wxyz"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(ranking.title_ratio("a", "b")).collect()] == [1.0, 0.0, 0.0]


EVENTS = [
    ("merge_hint", " a", "b", True, dt.datetime(2024, 1, 1)), ("merge_hint", "b", "a ", False, dt.datetime(2024, 1, 3)), ("merge_hint", "b", "a ", False, dt.datetime(2024, 1, 3)),
    ("merge_hint", "c", None, True, dt.datetime(2024, 1, 3)), ("bad_citation", "c", "d", None, None),
]


def test_feedback_latest(spark):
    df = spark.createDataFrame(EVENTS, "event_type string, left_id string, right_id string, accepted boolean, created_at timestamp_ntz")
    assert rows_n(feedback.latest(df).select("a", "b", "accepted", "events")) == [("a", "False", "b", "3"), ("c", "", "d", "1")]


def test_stream_counts_what_the_batch_counts(spark, tmp_path):
    df = spark.createDataFrame([e for e in EVENTS if e[2] and e[4]], "event_type string, left_id string, right_id string, accepted boolean, created_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    s = stream.window_counts(stream.cleaned(stream.events(spark, str(tmp_path / "in"))), "30 days")
    q = s.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert [(r.events, r.accepted) for r in spark.sql("select * from counts").collect()] == [(2, 1)]


def test_upsert_is_idempotent(spark):
    b = spark.createDataFrame([("m", "a", "b", True, dt.datetime(2024, 1, 1)), ("m", "a", "b", False, dt.datetime(2024, 1, 2))], "event_type string, a string, b string, accepted boolean, created_at timestamp")
    once = stream.upsert_latest(b, None)
    assert rows(stream.upsert_latest(b, once)) == rows(once) and once.first().accepted is False


def test_landing_source(spark, tmp_path):
    (tmp_path / "openalex").mkdir()
    (tmp_path / "openalex" / "W1.json").write_text('{"id": "W1"}')
    spark.dataSource.register(landing.LandingSource)
    df = spark.read.format("citeloom_landing").option("folder", str(tmp_path)).option("ids", json.dumps({"openalex": ["W1", "W2", "W1"]})).load()
    assert rows_n(df.select("source_id", "found")) == [("False", "W2"), ("True", "W1")]


def test_retry():
    tries = []

    class Flaky:
        name = "flaky"

        def fetch(self, ids):
            tries.append(1)
            if len(tries) < 3:
                raise OSError
            return {"a": "{}"}

    assert landing.fetch_with_retry(Flaky(), ["a"], sleep=lambda s: None) == {"a": "{}"} and len(tries) == 3


def test_reports(spark, papers, tmp_path):
    p = papers([paper("doi:10.1/a", title="A {x}", year=2020, authors=[("Ann", None), (None, None)]), paper("b")])
    e = {r.canonical_id: r.entry for r in reports.bibtex(p).collect()}
    assert e["doi:10.1/a"] == "@misc{doi_10_1_a,\n  title = {A \\{x\\}},\n  author = {Ann},\n  year = {2020},\n}"
    assert "Untitled" in e["b"]
    df = spark.createDataFrame([("q1", 0.9), ("q|2", 0.3)], "query string, composite double")
    lines = [r.line for r in reports.leaderboard(df, "query", "composite").orderBy("pos").collect()]
    assert lines[2] == "| 1 | q1 | 0.9000 |" and lines[-1].startswith("mean 0.6000")
    reports.write_json(df, str(tmp_path / "j"))
    assert rows(reports.read_json(spark, str(tmp_path / "j"), "query string, composite double")) == rows(df)
    assert reports.html_rows(spark.createDataFrame([("<a>",)], "x string"), ["x"]).first()[0] == "<tr><td>&lt;a&gt;</td></tr>"
    (tmp_path / "feed.xml").write_text('<?xml version="1.0"?><feed><entry><id>http://a/abs/2401.00001v1</id><title>T  one</title><published>2024</published><author><name>A</name></author></entry><entry><id>http://a/abs/2401.00001v2</id><title>T two</title><published>2025</published></entry></feed>')
    assert [(r.id, r.title, r.authors) for r in reports.atom_entries(spark, str(tmp_path / "feed.xml")).collect()] == [("2401.00001", "T one", ["A"])]


def test_stage_writes_and_drops(spark):
    s = Stage(spark, "t")
    df = s.put(spark.range(3))
    assert df.count() == 3
    s.drop(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._staged_at).count()


def test_empty_tables(spark, papers):
    n = graph.nodes(papers([]), "title", "doi", "arxiv_id", "openalex_id", "semantic_scholar_id", "references", "abstract", "year")
    e = graph.resolve_references(n)
    assert e.count() == 0 and graph.degrees(n, e).count() == 0 and graph.coupling(e, 2).count() == 0
    assert ranking.ranked(spark.createDataFrame([], "canonical_id string, s double"), "s").count() == 0


def test_branches(spark):
    from citeloom.operators import branches as B

    r = spark.createDataFrame(
        [("q", "cs", "a", "Graph networks for graphs", 3.0), ("q", "cs", "b", "Graph networks again", 2.0), ("q", "law", "c", None, 1.0), ("q", "law", "d", "A survey of rulings", None)],
        "query_id string, domain string, canonical_id string, title string, s double",
    )
    m = B.members(r, "query_id", "domain", "s")
    assert rows(m.select("canonical_id", "branch_rank", "branch_size")) == [("a", 1, 2), ("b", 2, 2), ("c", 1, 2), ("d", 2, 2)]
    c = {x.domain: x.coherence for x in B.coherence(m, "query_id", "domain").collect()}
    assert c["cs"] == pytest.approx(2 / 5) and c["law"] == 0.0
    assert {x.domain: x.label for x in B.labels(m, "query_id", "domain", ("graphs",)).collect()}["cs"] == "Graph Networks Again"
    e = spark.createDataFrame([("q", "a", "c"), ("q", "c", "b"), ("q", "a", "b")], "query_id string, src string, dst string")
    assert rows(B.bridges(e, m.select("query_id", "canonical_id", "domain"), "query_id", "domain")) == [("q", "cs", "law", 2)]


def test_seed_union_and_placeholders(spark):
    from citeloom.operators import branches as B

    s = lambda r: spark.createDataFrame(r, "key string, source string, pos long")
    got = rows(B.seed_union(s([("X", "anchor", 5)]), s([("x ", "search", 1), ("y", "search", 2), (None, "search", 3)])))
    assert got == [("x", "anchor", 5), ("y", "search", 2)]
    p = B.placeholders(spark.createDataFrame([("a", 0, "k1"), ("a", 1, "k2"), ("b", 0, "k2")], "src string, ref_pos int, key string"))
    assert rows_n(p.select("canonical_id", "previous")) == [("k1", ""), ("k2", "k1")]


def test_greedy_cap_lets_later_smaller_files_in(spark):
    from citeloom.operators import branches as B

    f = spark.createDataFrame([("p", 1, "a", 6), ("p", 2, "b", 6), ("p", 3, "c", 4)], "key string, pos long, name string, size long")
    assert [(r.name, r.kept) for r in B.greedy_cap(f, 10).orderBy("name").collect()] == [("a", True), ("b", False), ("c", True)]


def test_expansion(spark, papers):
    from citeloom.operators import expansion as E

    seeds = spark.createDataFrame([("doi", " 1", "api_search", 2), ("DOI", "1", "topic_discovered", 1), ("upload", "z", "api_search", 1), ("upload", "Z", "uploaded_pdf", 9), ("x", "y", None, 1)], "provider string, id string, origin string, pos long")
    assert rows(E.origin_map(seeds)) == [("doi:1", "discovered"), ("upload:z", "uploaded_pdf"), ("x:y", "discovered")]
    p = papers([paper("arxiv:2401.00001", 1, references=["W9"], doi="10.1234/a"), paper("openalex:W1", 2, doi="10.1234/A", references=["https://x.example/W3", None]), paper("arxiv:2401.00002", 3)])
    assert [(r.canonical_id, r.references, r.bridged) for r in E.bridged_references(p).orderBy("canonical_id").collect()] == [("arxiv:2401.00001", ["w3", "w9"], True), ("arxiv:2401.00002", [], False)]
    n = spark.createDataFrame([("a", 0.9), ("b", 0.1), ("c", 0.5)], "canonical_id string, s double")
    e = spark.createDataFrame([("a", "c", "high", None), ("a", "b", "high", None), ("c", "a", "LOW ", None), ("c", "a", None, "abstract_proxy"), ("c", "a", None, None)], "src string, dst string, confidence string, context_source string")
    kept, shown = E.visible(n, e, "s", 0.4, F.lit(False))
    assert rows(kept.select("canonical_id")) == [("a",), ("c",)] and shown.count() == 2
    assert one(spark, E.search_title, "Proceedings of the 3rd Workshop on Graphs, pages 1-9") == "3rd Workshop on Graphs"
    assert one(spark, E.search_title, "Vol") is None


@pytest.mark.parametrize("name, pairs", [("cocitation_pairs_all", {("c", "d", 1), ("c", "e", 1), ("d", "e", 2)}), ("coupling_pairs_all", {("a", "b", 2)})])
def test_pairs_that_share_one_or_two_works(spark, papers, tmp_path, name, pairs):
    import __spark_entry__ as entry

    rows_ = [paper("a", 0, references=["c", "d", "e"]), paper("b", 1, references=["d", "e"]), paper("c", 2), paper("d", 3), paper("e", 4)]
    papers(rows_).write.parquet(str(tmp_path / "papers.parquet"))
    assert {(r["a"], r["b"], r["shared"]) for r in entry.queries()[name](spark, str(tmp_path)).collect()} == pairs


def test_coupling_blocks_equal_brute_force_and_shuffle_no_pairs(spark):
    import itertools
    import random

    from citeloom.operators import graph as G

    rnd = random.Random(3)
    cites = {f"p{i:02d}": {"hot", *rnd.sample("uvwxyz", rnd.randint(0, 4))} for i in range(60)} | {"lone": {"alone"}}
    e = spark.createDataFrame([(a, x) for a, xs in cites.items() for x in xs], "src string, dst string")
    got = G.coupling(e, 1)
    assert {(r.a, r.b): r.shared for r in got.collect()} == {(a, b): len(cites[a] & cites[b]) for a, b in itertools.combinations(sorted(cites), 2) if cites[a] & cites[b]}
    assert G.coupled_blocks(e.distinct(), 100).count() == got.count()
    assert G.coupling(e.filter("false"), 1).count() == 0
    # what the counting reads is already where it is counted
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" not in plan and "hashpartitioning(least(" not in plan


def test_seeds_keep_their_sixth_reference_and_citer(spark, papers, tmp_path):
    import __spark_entry__ as entry

    refs, citers = [f"r{i}" for i in range(9)], [f"z{i}" for i in range(9)]
    rows_ = [paper("arxiv:1", 0, references=refs), *[paper(r, 1 + i) for i, r in enumerate(refs)], *[paper(c, 20 + i, references=["arxiv:1"]) for i, c in enumerate(citers)]]
    papers(rows_).write.parquet(str(tmp_path / "papers.parquet"))
    q = entry.queries()
    assert rows(q["second_hop_seeds_full"](spark, str(tmp_path))) == [("arxiv:1", r, i + 1) for i, r in enumerate(refs)]
    assert rows(q["broaden_pool_full"](spark, str(tmp_path))) == [(r, "reference") for r in refs] + [(c, "citer") for c in citers]


# --- titles, stars, display lines, diagnostics, metrics ---------------------------------------------------------


def test_title_links_need_no_common_word(spark):
    n = spark.createDataFrame([("a", "Enzymes dietary fibres"), ("b", "enzyme dietary fibre"), ("c", "Enzymes, dietary fears"), ("d", "é" * 40), ("e", "é" * 39), ("f", None)], "canonical_id string, title string")
    assert rows(resolve.title_links(n)) == [("a", "b"), ("d", "e")]


def test_close_titles_hold_all_near_ones():
    import difflib

    from citeloom.operators import titles as T

    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcdeé \u4e2d") for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    told = base + ["".join(c for c in b if rnd.random() > 0.06) or "x" for b in base] + ["a" * 70, "a" * 64, "z" * 150 + "b" * 100, "z" * 150 + "b" * 99]
    for least in (0.5, 0.8, 0.92):
        want = {(i, j) for i in range(len(told)) for j in range(i + 1, len(told)) if difflib.SequenceMatcher(a=told[i], b=told[j]).ratio() >= least}
        assert want <= set(T.close_pairs(told, told, least, True))
        assert want <= {(i, j + 30) for i, j in T.close_pairs(told[:30], told[30:], least)} | {p for p in want if (p[0] < 30) == (p[1] < 30)}


def test_best_ratios_equal_brute_force_with_few_ratios(monkeypatch):
    import difflib
    import re

    from citeloom.operators import titles as T

    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdefgéß中") for _ in range(rnd.randint(2, 9))) for _ in range(60)]
    told = [" ".join(rnd.sample(vocabulary, n)) for n in (1, 3, 6, 9, 14, 25, 50) for _ in range(50)] + ["graph " * 40]
    words = lambda s: {w for w in re.split(r"\W+", s) if len(w) > 3}
    x, y = told[::3], [t for i, t in enumerate(told) if i % 3]
    want = [max((difflib.SequenceMatcher(a=p, b=q).ratio() for q in y if words(p) & words(q)), default=0.0) for p in x]
    done = []
    ratio = T.Ratios.ratio
    monkeypatch.setattr(T.Ratios, "ratio", lambda self, t, j: done.append(j) or ratio(self, t, j))
    r = T.Ratios(y, [words(q) for q in y])
    assert [r.best(p, words(p)) for p in x] == want
    assert len(done) < sum(bool(words(p) & words(q)) for p in x for q in y) / 5
    assert T.Ratios([], []).best("abcd", {"abcd"}) == 0.0


def test_title_links_equal_brute_force(spark):
    import difflib

    from citeloom.operators import graph, resolve
    from citeloom.tables import table

    n = graph.nodes(table(spark, "/root/testdata/sf0.001", "papers"), "title")
    got = {tuple(sorted(r)) for r in resolve.title_links(n).select("a", "b").collect()}
    ids: dict = {}
    for r in n.select("canonical_id", F.lower("title").alias("t")).collect():
        if r.t and r.t.strip():
            ids.setdefault(r.t, []).append(r.canonical_id)
    want = {tuple(sorted((min(v), x))) for v in ids.values() for x in v if x != min(v)}
    keys = sorted(ids)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            m = difflib.SequenceMatcher(a=a, b=b)
            if m.real_quick_ratio() >= 0.92 and m.quick_ratio() >= 0.92 and max(m.ratio(), difflib.SequenceMatcher(a=b, b=a).ratio()) >= 0.92:
                want.add(tuple(sorted((min(ids[a]), min(ids[b])))))
    assert got == want


def test_contracted_long_chain_and_star(spark):
    from citeloom.operators.stars import contracted

    links = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)] + [("z0", f"z{i}") for i in range(1, 50)] + [("q", "q")]
    got = {(r.big, r.small) for r in contracted(spark.createDataFrame(links, "a string, b string"), hot_rows=10).collect()}
    assert got == {(f"n{i:03d}", "n000") for i in range(1, 121)} | {(f"z{i}", "z0") for i in range(1, 50)}
    assert contracted(spark.createDataFrame([], "a string, b string")).count() == 0


def test_display_lines_of_nulls_and_odd_values(spark):
    from citeloom.functions import display as D

    row = [(None, None, None, None, None), ("One two three four", " cs_theory ", "Unknown", " 10.1/X ", "A sentence that is long enough. More"), (" ", "", "J", "https://doi.org/10.2/y", "Short. More")]
    df = spark.createDataFrame(row, "title string, domain string, venue string, doi string, abstract string")
    got = [tuple(r) for r in df.select(D.short_title(F.col("title")), D.domain_label(F.col("domain")), D.venue_line(F.col("venue")), D.primary_url(F.lit(None).cast("string"), F.col("doi")), D.first_sentence(F.col("abstract"))).collect()]
    assert got == [("Untitled", "General", "", None, ""), ("One two three...", "Cs Theory", "", "https://doi.org/10.1/X", "A sentence that is long enough."), ("Untitled", "General", "J", "https://doi.org/10.2/y", "")]
    people = spark.createDataFrame([([(f"P{i}", None) for i in range(8)],), ([(" ", None)],), (None,)], "authors array<struct<name:string,orcid:string>>")
    assert [r[0] for r in people.select(D.authors_line(F.col("authors"))).collect()] == ["P0, P1, P2, P3, P4, P5 et al.", "", ""]


def test_search_strings(spark):
    from citeloom.functions import display as D

    df = spark.createDataFrame([("ti: graphs",), ('a "b"\n c',), (None,), ("  ",)], "t string")
    assert [r[0] for r in df.select(D.search_query(F.col("t"))).collect()] == ["ti: graphs", "all:a b c", "", ""]
    files = spark.createDataFrame([("a/b/Some_great-paper.v2.pdf",), ("draft.pdf",), ("12345678.pdf",), (None,), ("x.pdf",), ("Manuscript.pdf",)], "f string")
    assert [r[0] for r in files.select(D.file_stem(F.col("f"))).collect()] == ["Some great paper v2", None, None, None, None, None]
    assert spark.createDataFrame([("10.18653/v1/p19-1001",)], "d string").select(D.anthology_id(F.col("d"))).first()[0] == "P19-1001"
    bib = "@article{x,\n title = {A\n  long title},\n year={2020}}"
    assert tuple(spark.createDataFrame([(bib,)], "b string").select(D.bibtex_field(F.col("b"), "title"), D.bibtex_field(F.col("b"), "doi")).first()) == ("A long title", None)
    q = spark.createDataFrame([("ＡＢＣ​ Query",), ("data privacy rules",), (None,)], "q string")
    assert [r[0] for r in q.select(D.normalized_query(F.col("q"))).collect()] == ["abc query", "data privacy rules", None]
    assert [r[0] for r in q.select(F.size(D.query_variants(F.col("q")))).collect()] == [2, 3, 0]


def test_titles_for_a_query(spark):
    from citeloom.functions import display as D

    gold = {"graph": ["G"], "graph neural": ["GN"]}
    df = spark.createDataFrame([("Graph Neural ",), ("deep graph nets",), ("gra",), ("other",), (None,)], "q string")
    # an empty query is part of every key
    assert [r[0] for r in df.select(D.titles_for(F.col("q"), gold)).collect()] == [["GN"], ["G"], ["G"], [], ["G"]]


def _results(spark):
    q = spark.createDataFrame([(1, "graph neural networks", 3), (2, "sorting", 0), (3, "nothing", 0)], "query_id int, query string, paper_count int")
    f = spark.createDataFrame([(1, 0, "a", "Graph Neural Nets", "canonical", "A long explanation of this work."), (1, 1, "", "graph neural  nets", "", "short")], "query_id int, pos int, paper_id string, title string, role string, why string")
    b = spark.createDataFrame([(1, "x", 0, ["graph one", "graph two"], "graph expansion of everything here"), (1, "y", 1, ["alone"], "A branch with a readable text.")], "query_id int, branch_id string, pos int, titles array<string>, why string")
    c = spark.createDataFrame([(1, 0, "Unrelated", 0.1, 2000), (1, 1, "Networks of graphs", 0.9, 2012), (2, 0, "Sorting networks", None, None)], "query_id int, pos int, title string, semantic_score double, year int")
    gold = spark.createDataFrame([(1, "Graph neural nets and more"), (2, "Quicksort")], "query_id int, gold string")
    return q, f, b, c, gold


def test_all_metrics_by_hand(spark):
    from citeloom.operators import metrics

    got = {r.query_id: r for r in metrics.all_metrics(*_results(spark)).collect()}
    one = got[1]
    # titles: two foundational, three of branches, two candidates; "alone" and "Unrelated" share nothing
    assert one.intent_precision == round(5 / 7, 4)
    assert one.canonical_hit_rate == 1.0 and got[2].canonical_hit_rate == 0.0 and got[3].canonical_hit_rate == 1.0
    assert one.foundational_quality == round((1.0 + (0.15 + 0.3 - 0.4)) / 2, 4)
    assert one.noise_ratio == 0.5 and one.branch_coherence == round((1 / 3 + 0.5) / 2, 4)
    assert one.diversity == round(0.6 * 2 / 4 + 0.4, 4) and one.readability == round(2 / 4, 4) and one.hallucination_risk == 0.5
    assert got[2].hallucination_risk == 1.0 and got[3].hallucination_risk == 0.0
    assert (got[3].intent_precision, got[3].foundational_quality, got[3].readability) == (0.0, 0.5, 0.5)


def test_metrics_of_empty_tables(spark):
    from citeloom.operators import metrics

    q, f, b, c, gold = _results(spark)
    none = metrics.all_metrics(q, f.limit(0), b.limit(0), c.limit(0), gold.limit(0)).filter("query_id = 1").first()
    assert (none.intent_precision, none.canonical_hit_rate, none.foundational_quality, none.noise_ratio, none.branch_coherence) == (0.0, 1.0, 0.5, 0.0, 0.0)
    assert metrics.all_metrics(q.limit(0), f, b, c, gold).count() == 0
    acc = spark.createDataFrame([("Method Lookup", "method_lookup"), ("survey", "definition"), (None, "survey")], "p string, g string")
    assert acc.select(metrics.accuracy(F.col("p"), F.col("g"))).first()[0] == pytest.approx(1 / 3)


def test_discovery_budget_by_hand(spark):
    from citeloom.operators import diagnostics as X

    rows_ = [("sure", 0.2, 60, 50, True, 120, 0.25, 3, 0.0), ("vague", 1.0, 60, 50, True, 120, 0.25, 3, 0.0), ("cold", 0.2, 5, 50, False, 120, 0.25, 3, 0.0), ("zero", None, 60, 0, True, 0, 0.0, 0, None)]
    q = spark.createDataFrame(rows_, "q string, ambiguity double, seeds int, top_n int, two_hop boolean, budget int, concept double, coupling int, topic double")
    got = {r.q: r for r in X.discovery_budget(q).collect()}
    assert (got["sure"].budget, got["sure"].concept, got["sure"].coupling, got["sure"].bridge_factor) == (120, 0.25, 3, 0.45)
    assert got["vague"].budget == 78 and got["vague"].concept == pytest.approx(0.42) and got["vague"].bridge_factor == pytest.approx(0.6)
    assert got["cold"].two_hop and got["cold"].coupling == 2 and got["cold"].concept == 0.15 and got["cold"].topic == 0.2 and got["cold"].budget == 120
    # nothing or 0 means the default
    assert (got["zero"].top_n, got["zero"].budget, got["zero"].coupling) == (50, 120, 3)


def test_coherence_and_suppression(spark):
    from citeloom.operators import diagnostics as X

    df = spark.createDataFrame([("a", 1.0, 0.5, False, 0.0), ("b", 1.0, 0.0, True, 0.4), ("c", -1.0, 1.0, None, 0.25)], "canonical_id string, r double, c double, b boolean, p double")
    got = [round(r[0], 6) for r in df.select(X.coherence_adjusted(F.col("r"), F.col("c"), F.col("b"), F.col("p"))).collect()]
    assert got == [0.775, round(0.775 * 0.45 * 0.35, 6), 0.0]
    nodes = spark.createDataFrame([("a", True, None, None, None), ("b", None, None, 0.4, 0.3), ("c", None, None, 0.4, 0.9)], "canonical_id string, suppressed boolean, is_bridge boolean, penalty double, coherence double")
    rec = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "canonical_id string")
    assert sorted(r[0] for r in X.without_suppressed(rec, nodes).collect()) == ["c", "d"]
    tiers = spark.createDataFrame([(0.7, 0.5, False, None), (0.1, 0.36, False, None), (0.1, 0.1, False, None), (0.9, 0.9, True, None), (0.9, 0.9, False, "x")], "c double, s double, b boolean, k string")
    assert [r[0] for r in tiers.select(X.confidence_tier(F.col("c"), F.col("s"), F.col("b"), F.col("k"))).collect()] == ["core_intent", "moderate_intent", "citation_adjacent", "exploratory_connection", "cross_domain_bridge"]


def test_cosine_in_blocks(spark):
    from citeloom.operators.evaluation import cosine_top_k

    rnd = random.Random(3)
    v = spark.createDataFrame([(i, [rnd.random() for _ in range(4)]) for i in range(60)] + [(60, None), (61, [0.0] * 4)], "vec_id long, embedding array<float>")
    one, many = cosine_top_k(v, v.filter("vec_id % 3 = 0"), 4), cosine_top_k(v, v.filter("vec_id % 3 = 0"), 4, block=6)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


# --- lookups, providers, reading lists ----------------------------------------------------------------------------


def test_budget_keeps_its_interval():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    b = landing.Budget(0.5, lambda: now[0], sleep)
    b.acquire()
    now[0] += 0.2
    b.acquire()
    now[0] += 2
    b.acquire()
    assert slept == [pytest.approx(0.3)]


def test_busy_provider_is_given_time():
    waits, calls = [], []

    class Busy:
        name = "busy"

        def fetch(self, ids):
            calls.append(1)
            if len(calls) < 8:
                raise landing.TooManyRequests
            return {}

    assert landing.fetch_with_retry(Busy(), ["a"], sleep=waits.append) == {}
    assert waits == [2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 120.0]
    calls.clear()

    class Always(Busy):
        def fetch(self, ids):
            raise landing.TooManyRequests

    with pytest.raises(landing.TooManyRequests):
        landing.fetch_with_retry(Always(), ["a"], sleep=lambda s: None)


class EchoProvider:
    """A provider of its own for the next test."""

    def __init__(self, folder, name):
        self.name = name

    def fetch(self, ids):
        return {i: json.dumps({"id": i, "by": self.name}) for i in ids if i != "none"}


def test_reader_takes_a_provider_class(tmp_path):
    (tmp_path / "a.txt").write_text("x\tW7\nx\tnone\ny\tW1\n")
    r = landing.LandingReader({"folder": "", "requests": str(tmp_path), "classes": json.dumps({"x": "tests.test_core:EchoProvider", "y": "tests.test_core:EchoProvider"}), "intervals": json.dumps({"x": 0, "y": 0})})
    got = [row for p in r.partitions() for row in r.read(p)]
    assert got == [("x", "W7", '{"id": "W7", "by": "x"}', True), ("x", "none", None, False), ("y", "W1", '{"id": "W1", "by": "y"}', True)]
    many = landing.LandingReader({"folder": "", "ids": json.dumps({"x": [str(i) for i in range(260)]})}).partitions()
    # six batches on four partitions, each of which waits four intervals
    assert [len(p.batches) for p in many] == [2, 2, 1, 1] and {p.sharing for p in many} == {4}


def test_aliases_of_merged_works(spark):
    from citeloom.operators import lookup

    raw = [("openalex", "W1", json.dumps({"id": "https://x.example/W1", "ids": {"openalex": "https://x.example/w9", "mag": "123"}}), 1), ("openalex", "W1", json.dumps({"id": "https://x.example/W1"}), 2), ("openalex", "W3", "broken", 3), ("openalex", "W4", None, 4)]
    a = lookup.aliases_of_payloads(spark.createDataFrame(raw, "source string, source_id string, payload string, fetched_unix long"))
    assert rows(a) == [("W1", "openalex", "W1"), ("W9", "openalex", "W1")]
    got = lookup.by_alias(spark.createDataFrame([(" w9",), ("W2",), ("10.1/x",), (None,)], "key string"), a)
    assert sorted((str(r["key"]), r.source_id) for r in got.collect() if r.source_id) == [(" w9", "W1")] and got.count() == 4


def test_batches_hydration_and_refresh(spark):
    from citeloom.operators import lookup

    wanted = spark.createDataFrame([(f"W{i}",) for i in range(130)] + [("W1",), ("x",), (None,)], "id string")
    b = lookup.missing_batches(wanted, spark.createDataFrame([("W5",)], "id string")).collect()
    ids = [i for r in b for i in r.ids]
    assert len(ids) == len(set(ids)) == 129 and max(len(r.ids) for r in b) <= 50
    rec = spark.createDataFrame([("a", "W1", "Pending"), ("b", "W2", "Pending"), ("c", None, "Pending"), ("d", "W1", "Own")], "canonical_id string, openalex_id string, title string")
    rounds = [spark.createDataFrame([("W9", "Nine")], "openalex_id string, title string"), spark.createDataFrame([("W1", "One")], "openalex_id string, title string")]
    got = {r.canonical_id: (r.title, r.graph_noise) for r in lookup.hydrated(rec, rounds, F.col("title") == "Pending").collect()}
    assert got == {"a": ("One", False), "b": ("Pending", True), "c": ("Pending", False), "d": ("Own", False)}
    nodes = spark.createDataFrame([("a", "old", 3), ("b", "old", 4)], "id string, title string, rank int")
    fresh = spark.createDataFrame([("a", "new", 99), ("b", None, 98)], "id string, title string, rank int")
    assert rows(lookup.refreshed(nodes, fresh, "id", ("rank",))) == [("a", "new", 3), ("b", "old", 4)]


def test_zip_concepts_and_routing(spark):
    from citeloom.operators import lookup

    seeds = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.2), (1, 2, None)], "query_id int, seed_pos int, concept_score double")
    rec = spark.createDataFrame([(1, 0, "a", [("openalex", 0.0)]), (1, 2, "c", [])], "query_id int, seed_pos int, canonical_id string, sources array<struct<source:string,score:double>>")
    assert {r.canonical_id: [s.source for s in r.sources] for r in lookup.zipped(seeds, rec).collect()} == {"a": ["openalex", "topic_probe"], "c": []}
    raw = spark.createDataFrame([("W1", json.dumps({"id": "W1", "concepts": [{"id": "https://x.example/C7", "score": 0.9}]})), ("W2", json.dumps({"id": "W2", "concepts": [{"id": "C7", "score": 0.5}]})), ("W3", "no")], "source_id string, payload string")
    assert rows(lookup.concept_works(raw, "C7")) == [("W1", 0.9)]
    err = {r.provider: r.error for r in lookup.routed(spark.createDataFrame([(" OpenAlex",), ("unknown",), (None,)], "provider string")).collect()}
    assert err[" OpenAlex"] is None and "arxiv" in err["unknown"] and err[None].startswith("no provider ?")


def test_missing_link_details(spark, papers):
    from citeloom.operators import lookup

    raw = json.dumps({"cited_by_count": 42, "concepts": [{"id": "https://x.example/C1", "score": 0.31}]})
    p = papers([paper("a", provenance=[("openalex", "W1", None, None, raw)]), paper("b", provenance=[("foundational_hub", "x", None, None, None)]), paper("c", provenance=[("openalex", "W", None, None, "broken")]), paper("d")])
    c = spark.createDataFrame([("a", 3), ("b", 1), ("c", 9), ("d", 9), ("gone", 2)], "canonical_id string, links int")
    got = {r[0]: tuple(r)[1:] for r in lookup.missing_link_details(c, p, "C1").collect()}
    assert got == {"a": (3, 42, 0.31, True), "b": (1, 0, 0.0, True), "c": (9, 0, 0.0, False), "d": (9, 0, 0.0, False), "gone": (2, 0, 0.0, False)}


def test_reading_list_of_nothing(spark, papers):
    from citeloom.operators import graph as G_
    from citeloom.operators import reading

    n = G_.nodes(papers([paper("a", 0, title="Graph networks", references=["b"]), paper("b", 1, title=None)]), "title", "abstract", "year", "domain", "references", "doi", "openalex_id", "arxiv_id", "semantic_scholar_id")
    e = G_.resolve_references(n)
    q = spark.createDataFrame([(1, "graph networks"), (2, "zzz"), (3, None)], "query_id int, query string")
    r = reading.ranked_pool(q, n, e, G_.degrees(n, e), 2026)
    assert [(x.query_id, x.canonical_id, x.origin, x["rank"]) for x in r.orderBy("rank").collect()] == [(1, "a", "api_search", 1), (1, "b", "discovered", 2)]
    md = {x.query_id: x.markdown for x in reading.report(q, reading.sections(r), n).collect()}
    assert md[1].startswith("# graph networks\n\n## Branch: unknown\n- ") and md[2] == "# zzz" and "Untitled" in md[1]


# --- uploads, stores, branch reports ------------------------------------------------------------------------------


def test_upload_gate_pool_and_seeds(spark):
    from citeloom.operators import uploads as U

    prev = [(0, "doi", "10.1/a", 0.9, False, ["10.2/x", " 10.2/x ", None, "10.2/y"]), (1, "arxiv", "1", 0.5, True, ["10.2/z", "10.2/y"]), (2, "doi", "10.1/b", 0.5, None, ["10.2/q"]), (3, "doi", " ", 0.1, None, None), (4, "doi", "10.1/c", None, None, [])]
    p = spark.createDataFrame(prev, "pos int, provider string, id string, mapping_score double, quality_override boolean, references array<string>")
    g = U.gated(p)
    assert [r.state for r in g.orderBy("pos").collect()] == ["seed", "overridden", "blocked", "unresolved", "seed"]
    assert tuple(U.gate_statistics(g).first()) == (2, 1, 1, 0.8)
    pool = U.reference_pool(p, 4)
    assert [(r.id, r.pool_pos) for r in pool.orderBy("pool_pos").collect()] == [("10.2/x", 1), ("10.2/y", 2), ("10.2/z", 3), ("10.2/q", 4)]
    s = U.seeds(g, spark.createDataFrame([("openalex", "W1", 7)], "provider string, id string, pos int"), pool)
    assert [(r.id, r.origin) for r in s.orderBy("part", "pos").collect()][:4] == [("10.1/a", "uploaded_pdf"), ("1", "uploaded_pdf"), ("10.1/c", "uploaded_pdf"), ("W1", "discovered_2hop")]


def test_upload_decisions_in_order(spark):
    from citeloom.operators import uploads as U

    schema = "arxiv string, doi string, known_arxiv boolean, known_doi boolean, title_id string, title_score double, stem_id string, stem_score double"
    cases = [("2301.00001", "10.1/a", True, True, "W1", 0.9, None, None), ("2301.00001", "10.48550/arxiv.2301.00001", None, True, None, None, None, None), (None, "10.1/a", None, None, None, None, None, None), ("2301.00001", None, None, None, None, None, None, None), (None, None, None, None, "W1", 0.91234, "W2", 0.5), (None, None, None, None, None, None, "W2", 0.5), (None,) * 8]
    got = [(r.provider, r.id, r.mapping_score, r.resolution) for r in U.decided(spark.createDataFrame(cases, schema)).collect()]
    assert got == [("arxiv", "2301.00001", 0.98, "pdf_text"), ("doi", "10.48550/arxiv.2301.00001", 0.98, "doi"), ("doi", "10.1/a", 0.92, "doi"), ("arxiv", "2301.00001", 0.82, "pdf_text"), ("openalex", "W1", 0.9123, "pdf_text"), ("openalex", "W2", 0.5, "filename"), ("unresolved", "", 0.0, "pdf_text")]


def test_title_similarity_and_fit(spark):
    import difflib

    from citeloom.operators import uploads as U

    c = spark.createDataFrame([("a", "Deep graph networks"), ("b", "Nothing here"), ("c", None)], "canonical_id string, title string")
    anchors = spark.createDataFrame([("Graph networks, deeply",), ("Deep seas",), (None,)], "title string")
    want = max(difflib.SequenceMatcher(a="deep graph networks", b=x).ratio() for x in ("graph networks, deeply", "deep seas"))
    assert {r[0]: r[1] for r in U.best_title_similarity(c, anchors).collect()} == {"a": pytest.approx(want), "b": 0.0, "c": 0.0}
    x = U.fit_columns(spark.createDataFrame([("Graph nets", "All about nets", "graph nets"), (None, None, None)], "title string, abstract string, query string"))
    got = [r[0] for r in x.select(U.semantic_fit(F.split("query", " "), F.col("query"))).collect()]
    assert got == [pytest.approx(0.4 + 0.48), 0.45]


def test_projects_and_feedback_stores(spark, tmp_path):
    from citeloom.sources import stores

    p = stores.Projects(spark, f"file://{tmp_path}/p")
    assert p.list().count() == 0
    stem = p.save("My project: é", {"a": [1, 2], "b": None})
    assert p.load(stem) == {"a": [1, 2], "b": None} and [r.name for r in p.list().collect()] == ["My project: é"]
    (tmp_path / "p" / "old.json").write_text('{"schema_version": 0, "session": {}}')
    (tmp_path / "p" / "bad.json").write_text("no json")
    with pytest.raises(ValueError):
        p.load("old")
    with pytest.raises(FileNotFoundError):
        p.load("none")
    assert {r.stem: r.name for r in p.list().collect()} == {stem: "My project: é", "old": "old", "bad": "bad"}
    assert p.delete(stem) and not p.delete(stem)
    f = stores.FeedbackTable(spark, f"file://{tmp_path}/f")
    assert f.events().count() == 0
    f.merge_hint("a", "b", True)
    f.bad_citation("c", "d")
    f.add(spark.createDataFrame([("x", "l", "r", None, dt.datetime(1999, 1, 1))], "event_type string, left_id string, right_id string, accepted boolean, created_at timestamp"))
    assert [r.event_type for r in f.events().collect()][-1] == "x" and f.events().count() == 3
    f.replace(spark.createDataFrame([("y", "l", "r", True, None)], stores.EVENTS))
    assert [r.event_type for r in f.events().collect()] == ["y"]
    f.clear()
    assert f.events().count() == 0


def test_branch_reports_by_hand(spark):
    from citeloom.operators import branches as B
    from citeloom.operators import uploads

    m = [(1, "x", "a", "graph nets", True, 0.8, 0.9, ["t"], 1), (1, "x", "b", "graph walks", False, 0.4, 0.5, ["t", "u", "t"], 2), (1, "y", "c", "law of courts", None, 0.0, 0.0, ["u"], 1), (2, "x", "d", None, True, 1.0, 1.0, [], 1)]
    df = spark.createDataFrame(m, "q int, d string, canonical_id string, title string, matches boolean, topical double, purity double, themes array<string>, branch_rank int")
    got = {(r.q, r.d): r for r in B.purity_report(df, "q", "d").collect()}
    assert got[1, "x"].score == 0.025 and got[1, "x"].theme == "t" and got[1, "x"].contamination == 1.0
    assert got[1, "y"].score == 0.0 and got[2, "x"].score == 1.0 and got[2, "x"].level == "high" and got[2, "x"].theme is None
    labels = {(r.q, r.d): r.label for r in B.voted_labels(df, "q", "d", F.lit("graph law"), ("nets",)).collect()}
    assert labels[1, "x"] == "Graph Walks" and labels[2, "x"] == "Graph"
    e = spark.createDataFrame([(1, "a", "c"), (1, "a", "b")], "q int, src string, dst string")
    assert rows(B.unexpected_connections(df, e, "q", "d")) == [(1, "x", "y", 0.0)]
    assert {(r.q, r.canonical_id) for r in uploads.promoted(df.withColumn("is_hub", F.lit(False)), "q", "topical", "purity").filter("is_hub").collect()} == {(1, "a"), (2, "d")}


def test_spiked_distribution(spark):
    df = spark.createDataFrame([("gpu accelerated tessellation shader hardware pipeline",), ("what is garbage collection",)], "q string")
    got = df.select(query_intent.classified(F.col("q")).alias("c")).select("c.*").collect()
    for r, q in zip(got, df.collect()):
        if r.recency_boost:
            assert r.distribution["hardware_system"] == query_intent.SPIKE
        assert sum(r.distribution.values()) == pytest.approx(1, abs=0.01)
    one = spark.createDataFrame([({"a": 0.5, "b": 0.5},)], "m map<string,double>").select(query_intent.spiked(F.col("m"), "c", 0.9)).first()[0]
    assert one == {"a": 0.05, "b": 0.05, "c": 0.9}


def test_neighbourhood_equals_a_queue(spark):
    from citeloom.operators import expansion

    rnd = random.Random(2)
    nodes = [(q, f"n{i:02d}", round(rnd.random(), 2), q == 0 and i in (3, 7)) for q in (0, 1) for i in range(30)]
    edges = [(q, f"n{rnd.randrange(30):02d}", f"n{rnd.randrange(30):02d}") for q in (0, 1) for _ in range(25)]
    got = {}
    for r in expansion.neighbourhood(spark.createDataFrame(nodes, "q int, canonical_id string, score double, is_seed boolean"), spark.createDataFrame(edges, "q int, src string, dst string"), "q", "score", 12).orderBy("place").collect():
        got.setdefault(r.q, []).append(r.canonical_id)
    for q in (0, 1):
        score = {i: s for k, i, s, _ in nodes if k == q}
        order = lambda ids: sorted(ids, key=lambda i: (-score[i], i))
        seeds = order([i for k, i, _, f in nodes if k == q and f]) or order(score)[:3]
        taken, queue = list(seeds), list(seeds)
        while queue and len(taken) < 12:
            a = queue.pop(0)
            for b in order({y if x == a else x for k, x, y in edges if k == q and a in (x, y) and x != y} - set(taken)):
                if len(taken) < 12:
                    taken.append(b)
                    queue.append(b)
        taken += [i for i in order(score) if i not in taken][: 12 - len(taken)]
        assert got[q] == taken


def test_html_page_and_engine(spark, tmp_path):
    from citeloom.engine import Engine

    df = spark.createDataFrame([("a<b", 0.2), ("c&d", 0.9), (None, None)], "name string, composite double")
    page = reports.html_page(df, "R & D", ["name", "composite"], "composite").first().html
    assert page.index("c&amp;d") < page.index("a&lt;b") and "<title>R &amp; D</title>" in page and page.count("<tr>") == 4
    e = Engine(spark, "/root/testdata/sf0.001", f"file://{tmp_path}")
    q = spark.createDataFrame([(1, "machine learning systems")], "query_id int, query string")
    lists = e.reading_lists(q)
    assert set(lists.columns) == {"query_id", "section", "label", "pos", "canonical_id", "relevance"} and e.reports(q).count() == 1
    e.decisions.merge_hint("a", "b", True)
    assert e.works().count() > 0 and e.search(q).columns == ["query_id", "canonical_id", "score", "rank"]
    assert e.close() > 0
