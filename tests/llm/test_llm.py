from __future__ import annotations

import base64
import bisect
import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.llm import components, cooccurrence, matching, names, packing, subjects, survivors, tokens
from citeloom.staging import Stage
from tests.conftest import SF, paper


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- 1: components -------------------------------------------------------------------------------------------


def brute_components(pairs):
    group = {}
    for a, b in pairs:
        ga, gb = group.setdefault(a, {a}), group.setdefault(b, {b})
        if ga is not gb:
            ga |= gb
            for x in gb:
                group[x] = ga
    return sorted((min(g), x) for x, g in group.items())


@pytest.mark.parametrize("case", ["chain", "star", "random", "empty"])
def test_components_equal_union_find(spark, case):
    rnd = random.Random(3)
    pairs = {
        "chain": [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)],
        "star": [("hub", f"x{i}") for i in range(60)] + [("a", "hub")],
        "random": [(f"v{rnd.randint(0, 60)}", f"v{rnd.randint(0, 60)}") for _ in range(50)] * 2,
        "empty": [],
    }[case]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert rows(components.connected_components(df, hot_rows=10)) == brute_components([p for p in pairs if p[0] != p[1]])


def test_links_take_the_latest_decision(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    f = [
        ("merge_hint", "a", " b\t", True, t(1)), ("merge_hint", "b", "a", False, t(2)), ("merge_hint", "c", "d", False, t(1)), ("merge_hint", "d", "c", True, t(3)),
        ("merge_hint", "e", "f", True, t(1)), ("merge_hint", "e", "f", None, t(2)), ("bad_citation", "g", "h", True, t(1)), ("merge_hint", "i", None, True, t(1)),
        ("merge_hint", "j", " j", True, t(1)), ("merge_hint", "k", "l", True, None), ("merge_hint", "m", "n", True, t(1)), ("merge_hint", "m", "n", False, t(1)),
    ]
    feedback = spark.createDataFrame(f, "event_type string, left_id string, right_id string, accepted boolean, created_at timestamp_ntz")
    audits = spark.createDataFrame([([("x", " y"), (None, "z")],), (None,), ([],)], "merged_pairs array<struct<left_id:string,right_id:string>>")
    assert rows(components.accepted_links(feedback, audits)) == [("c", "d"), ("k", "l"), ("m", "n"), ("x", "y")]


# --- 2: names ------------------------------------------------------------------------------------------------


@given(st.lists(st.text("abc", min_size=1, max_size=7), max_size=25), st.text("abc", max_size=7), st.integers(0, 2))
@settings(max_examples=150, deadline=None)
def test_trie_traversal_equals_brute_force(held, word, d):
    want = sorted({w for w in held if brute_damerau(w, word) <= d})
    assert sorted(names.traverse(names.build_trie(held), word, d)) == want


def brute_damerau(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_trie_join_finds_all_neighbours(spark):
    rnd = random.Random(5)
    words = {"".join(rnd.choice("abcd") for _ in range(rnd.randint(6, 9))) for _ in range(60)}
    for w in list(words)[:40]:
        i = rnd.randrange(len(w) - 1)
        words |= {w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + w[i + 1 :], w[:i] + "x" + w[i:]}
    words = {w for w in words if len(w) >= 6}
    want = sorted((a, b) for a in words for b in words if a != b and brute_damerau(a, b) <= 1)
    assert rows(names.trie_neighbours(spark.createDataFrame([(w,) for w in words], "t string"), 1)) == want


SAME = [
    ("Ann Marie Kowalskova", "Kowalskova, Ann M."), ("Beth Averem", "Elizabeth Averem"), ("M. van der Svenosendor", "Maria van der Svenosendor"), ("Dr. Jürgen Toreford", "JURGEN TOREFORD"),
    ("Toreford A", "Arjun Toreford"), ("ArjunToreford", "Arjun Toreford"), ("Avererhanita DK", "Dana Kim Avererhanita"), ("Agnes Osteredkunouils*", "Agnès Osteredkunoulis"), ("Ted Lanunov", "T. Lanunov"),
    ("The Klando Imaging Consortium", "Klando Imaging Cons."), ("Imaging Consortium Klando", "Klando Imaging Consortium (KLANIC)"),
]
OTHER = [("Ann Kowalskova", "Bea Kowalskova"), ("Edward M. Varadbeberg", "Edward Maverliford"), ("Márta A. Lunomont", "Márta Averomann"), ("Klando Imaging Consortium", "Brevo Imaging Consortium"), ("", "Ann"), ("Ann", "Ann Kowalskova")]


@pytest.mark.parametrize("a, b", SAME)
def test_spellings_of_one_name(a, b):
    assert names.compatible(names.parse(a)[0], names.parse(b)[0], names._nick_table()) >= 0.5


@pytest.mark.parametrize("a, b", OTHER)
def test_other_names(a, b):
    assert names.compatible(names.parse(a)[0], names.parse(b)[0], names._nick_table()) < 0.5


def test_acronyms_and_orcids(spark):
    assert "babriti" in names.acronyms(names.parse("The Babrinfi Trial Investigators")[0])
    df = spark.createDataFrame([("https://orcid.example/0000-0002-1825-0097",), ("0000000218250097",), ("0000-0002-1825-0098",), ("n/a",), (None,), ("0000-0002-1694-233x",)], "o string")
    assert [r[0] for r in df.select(names.orcid(F.col("o"))).collect()] == ["0000000218250097", "0000000218250097", None, None, None, "000000021694233X"]


def test_forms_with_common_tokens_are_all_judged(spark, monkeypatch):
    monkeypatch.setattr(names, "COMMON_FORMS", 2)
    monkeypatch.setattr(names, "COMMON_SHARE", 0.0)
    forms = ["milan pennechruhart", "milan pennethruhatr", "karoly oste heskonsen", "karoly osteheskonsen", "x wang", "xiaoli wang", "wei wang", "wang", "jun wang", "wang li", "milan novak", "milna novak", "karoly novak", "w li", "wei li", "te novak", "tomas emil novak", "liz novak", "e novak", "elizabeth novak", "chen smith", "cehn smith", "anna smith"]
    nick = names._nick_table()
    want = sorted((f, g) for f in forms for g in forms if f < g and names.compatible(f, g, nick) > 0)
    assert ("milan pennechruhart", "milan pennethruhatr") in want and ("karoly oste heskonsen", "karoly osteheskonsen") in want and ("x wang", "xiaoli wang") in want
    df = spark.createDataFrame([(f, "") for f in forms], "form string, acronym string")
    assert rows(names.form_pairs(df, Stage(spark, "common")).select("f", "g")) == want


AUTHORS = [
    (1, "Ann Marie Kowalskova", "0000-0002-1825-0097", "University of Brunlo", "x"), (2, "Kowalskova, Ann M.", None, "Brunlo Univ", "x"), (3, "Ann Kowalskova", None, None, "x"),
    (4, "Ann Kowalskova", "0000-0002-1694-233X", "Tech of Zundar", "x"), (5, "Bea Kowalskova", None, "University of Brunlo", "x"), (6, None, None, None, "x"), (7, " ", None, "University of Brunlo", "x"),
    (8, "Klando Imaging Consortium (KLANDIC)", None, "Pinto Academy of Sciences", "x"), (9, "KLANDIC", None, "PintoAS", "x"), (9, "KLANDIC", None, "PintoAS", "x"),
]
AUTHOR = "author_no long, name string, orcid string, affiliation string, grp string"


def test_variants_of_small_table(spark):
    got = rows(names.variant_pairs(spark.createDataFrame(AUTHORS, AUTHOR)))
    assert (1, 2) in got and (8, 9) in got
    assert not {(1, 4), (2, 4), (1, 5), (2, 5), (4, 5)} & set(got) and not any(6 in p or 7 in p for p in got)
    assert names.variant_pairs(spark.createDataFrame([], AUTHOR)).count() == 0


@given(st.text("abcd", min_size=1, max_size=9), st.lists(st.tuples(st.sampled_from("drix"), st.integers(0, 9), st.sampled_from("abcde")), max_size=3))
@settings(max_examples=300, deadline=None)
def test_automaton_and_bounded_distance_equal_the_distance(a, edits):
    b = list(a)
    for kind, i, c in edits:
        i %= len(b) + 1
        if kind == "i":
            b.insert(i, c)
        elif kind == "d" and b:
            b.pop(min(i, len(b) - 1))
        elif kind == "r" and b:
            b[min(i, len(b) - 1)] = c
        elif len(b) > 1:
            i = min(i, len(b) - 2)
            b[i], b[i + 1] = b[i + 1], b[i]
    b = "".join(b)
    for d in (1, 2):
        want = names.damerau(a, b) <= d
        assert names.within(a, b, d) == want
        assert (names.traverse(names.build_trie([b]), a, d) == [b]) == want if b else True


def test_links_in_stars_join_what_all_pairs_would(spark):
    """Units of two fitting forms with and without ORCIDs, at places: components of the links against those of all pairs."""
    rnd = random.Random(5)
    units = [(i, rnd.choice("fgh"), rnd.choice([None, None, "o1", "o2", "o3"]), rnd.choice(["p", "q", None])) for i in range(40)]
    pairs = [("f", "f"), ("g", "g"), ("h", "h"), ("f", "g"), ("g", "f")]
    df = spark.createDataFrame(units, "unit long, form string, o string, p string")
    for at in ([], ["p"]):
        links = names._fitting(df, spark.createDataFrame(pairs, "f string, g string"), at).collect()
        every = [(a, b) for a, fa, oa, pa in units for b, fb, ob, pb in units if a < b and (fa, fb) in pairs and not (oa and ob) and (not at or pa and pa == pb)]
        # nothing that all pairs would keep apart is linked
        assert {(min(r), max(r)) for r in map(tuple, links)} <= set(every)

        def components(edges):
            root = {u[0]: u[0] for u in units}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in edges:
                root[find(a)] = find(b)
            groups: dict = {}
            for x in root:
                groups.setdefault(find(x), set()).add(x)
            return sorted(map(sorted, groups.values()))

        assert components(map(tuple, links)) == components(every)


# --- 5: matching ---------------------------------------------------------------------------------------------


def work(i, pos, title, **kw):
    return paper(i, pos, title=title, **kw)


def test_matching_of_small_table(spark, papers):
    a = [("Ann Kowalskova", None), ("Bo Nakamura", None)]
    p = papers([
        work("doi:10.1234/a", 1, "Reactor cooling under stress: lessons of the Vando project", doi="10.1234/a", year=2020, authors=a), work("openalex:W1", 2, "Reactor coolng under stress", year=2020, authors=a),
        work("arxiv:2001.00001", 3, "Preprint: Reactor cooling under stress: lessons of the Vando project", year=2019, authors=a, doi="https://doi.example/10.1234/A"),
        work("openalex:W2", 4, "Correction to: Reactor cooling under stress: lessons of the Vando project", year=2020, authors=a), work("doi:10.1234/b", 5, "Reactor cooling under stress: lessons of the Vando project (Part II)", doi="10.1234/b", year=2021, authors=a),
        work("doi:10.1234/c", 6, None), work("doi:10.1234/d", 7, "untitled"), work("openalex:W4", 8, "untitled"), work("openalex:W1", 9, "Reactor coolng under stress", year=2020, authors=a), paper(None, 10),
    ])
    got = {(r.left_id, r.right_id): r.p for r in matching.match(p).collect()}
    assert set(got) == {("arxiv:2001.00001", "doi:10.1234/a"), ("arxiv:2001.00001", "openalex:W1"), ("doi:10.1234/a", "openalex:W1")}
    assert all(0.5 <= x <= 1 for x in got.values())
    assert matching.match(papers([])).count() == 0


def brute_beliefs(pairs, second, rounds=60):
    """Messages computed pair by pair."""
    v = {p: [0.0, 0.0] for p in range(len(pairs))}
    for i in range(rounds):
        new = {}
        for p, (a, b, sa, sb, th) in enumerate(pairs):
            def out(end, src, other, other_src, skip):
                s = 0.0
                for q, (c, d, sc, sd, t2) in enumerate(pairs):
                    if q == skip:
                        continue
                    if c == end and sd == other_src:
                        s += np.exp(t2 + v[q][1])
                    if d == end and sc == other_src:
                        s += np.exp(t2 + v[q][0])
                return np.log((1 + second * s) / (1 + s))
            new[p] = [out(a, sa, b, sb, p), out(b, sb, a, sa, p)]
        keep = 0.5 if i > 2 else 0.0
        v = {p: [keep * v[p][k] + (1 - keep) * new[p][k] for k in (0, 1)] for p in v}
    return [1 / (1 + np.exp(-(th + sum(v[p])))) for p, (_, _, _, _, th) in enumerate(pairs)]


def test_propagation_equals_brute_force(spark):
    pairs = [(1, 2, "x", "y", 3.0), (1, 3, "x", "y", 1.0), (4, 3, "x", "y", 0.5), (5, 6, "x", "z", 0.2), (2, 6, "y", "z", 2.0)]
    df = spark.createDataFrame(pairs, "a long, b long, sa string, sb string, theta double")
    got = {(r.a, r.b): r.p for r in matching.propagate(df, Stage(spark, "t"), rounds=40, tolerance=1e-9).collect()}
    assert [got[a, b] for a, b, *_ in pairs] == pytest.approx(brute_beliefs(pairs, matching.SECOND), abs=1e-4)
    assert got[1, 2] > 0.9 and got[1, 3] < 0.6


def test_judge_looks_at_a_token_once(monkeypatch):
    """How a token looks is found out once for all pairs it is in, and words that differ at both ends get no distance."""
    seen, near = [], []
    look, within = names._seen, names.within
    monkeypatch.setattr(names, "_seen", lambda t: seen.append(t) or look(t))
    monkeypatch.setattr(names, "within", lambda a, b, d: near.append((a, b)) or within(a, b, d))
    fit = names.Judge()
    forms = ["maria castorp", "maria settembrini", "m castorp", "maria castrop", "peeperkorn maria"]
    got = [[fit(f, g) > 0 for g in forms] for f in forms]
    assert [sum(r) for r in got] == [3, 1, 3, 3, 1]
    assert sorted(seen) == sorted({t for f in forms for t in f.split()})
    assert ("castorp", "maria") not in near and ("castorp", "castrop") in near


def test_candidates_equal_brute_force_with_hot_keys(spark):
    """No pair whose shared keys weigh enough is lost, however many records have its keys."""
    rnd = random.Random(11)
    words, people = "abcdefghijklmn", "opqrstuvwxyz"
    title = lambda: [(9, w, 1.0) for w in sorted(rnd.sample(words, 7))]
    data = [(i, title(), [(9, n, 1.0) for n in sorted(rnd.sample(people, rnd.choice((0, 0, 2, 3))))], [f"i{i % 11}"] if i % 4 == 0 else [], [], None, rnd.choice((None, 2001, 2002))) for i in range(60)]
    s = "array<struct<df:long,t:string,w:double>>"
    r = spark.createDataFrame(data, f"rid long, title {s}, names {s}, ids array<string>, sentences array<long>, venue string, year int")
    keys = matching.blocking_keys(r).cache()
    own: dict = {}
    for x in keys.collect():
        own.setdefault(x.rid, {})[x.key] = x.w
    pairs = list(itertools.combinations(range(60), 2))
    want = {(a, b) for a, b in pairs if sum(w for k, w in own[a].items() if k in own[b]) >= matching.ENOUGH}
    for common in (1, 2, 4, 8, 64):
        got = {tuple(x) for x in matching.candidate_pairs(keys, r, Stage(spark, "t"), common).collect()}
        assert want <= got, common
    assert got == want and len(want) < len(pairs)


def test_hot_keys_add_no_pairs(spark):
    """However few records make a key hot, candidates are those whose shared keys weigh enough, not one more; four words in a year are enough."""
    title = lambda ws: [(9, w, 1.0) for w in sorted(ws)]
    name = lambda *ns: [(9, n, 1.0) for n in sorted(ns)]
    data = [
        (1, title("abcdex"), name("o", "p"), [], [], None, 2001), (2, title("abcdfy"), name("o", "q"), [], [], None, 2002), (3, title("abghz"), name("o", "p"), [], [], None, 2001),
        (4, title("abcduv"), name("s"), [], [], None, 2001), (5, title("abcuv"), name("t"), [], [], None, 2004), (6, title("abcghi"), name("s", "t"), [], [], None, 2004),
    ]
    s = "array<struct<df:long,t:string,w:double>>"
    r = spark.createDataFrame(data, f"rid long, title {s}, names {s}, ids array<string>, sentences array<long>, venue string, year int")
    for common in (1, 64):
        got = {tuple(x) for x in matching.candidate_pairs(matching.blocking_keys(r, threes=False), r, Stage(spark, "t"), common).collect()}
        # 1, 2: four words and a name; 1, 3: two names, two words, a year; 1, 4: four words and a year; 4, 5: five words; 5, 6 and 4, 6: three words and a name with three of them
        assert got == {(1, 2), (1, 3), (1, 4), (4, 5), (4, 6), (5, 6)}, common


def test_letters_turn_down_no_near_words(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(3, 11)))

    def slip(w):
        i, x = rnd.randrange(len(w)), rnd.choice("abcdefgxyz")
        return rnd.choice((w[:i] + x + w[i + 1:], w[:i] + w[i + 1:], w[:i] + x + w[i:], w[:i] + w[i:i + 2][::-1] + w[i + 2:]))

    words_ = [w for x in (word() for _ in range(60)) for w in (x, slip(x), slip(slip(x)))]
    r = spark.createDataFrame([(i, [w]) for i, w in enumerate(words_)], "rid long, title array<string>")
    one = matching.weighed(r, "title", len(words_), Stage(spark, "t")).select(F.col("title")[0].alias("x")).distinct()
    both = one.crossJoin(one.select(F.col("x").alias("y"))).filter(matching.near(F.col("x.t"), F.col("y.t")))
    n = both.agg(F.count(F.lit(1)), F.count_if(~matching._may_be_near(F.col("x"), F.col("y")))).first()
    assert n[0] > len(words_) and n[1] == 0


def test_short_title_meets_its_longer_form(spark, papers):
    rows_ = [
        paper("arxiv:1", 0, title="Código fuente y modelos de lenguaje", year=2020), paper("doi:1", 1, title="Código fuente y modelos de lenguaje: el caso de Funsinfa para motores antiguos", year=2012),
        paper("arxiv:2", 2, title="Grammars"), paper("doi:2", 3, title="Grammars of northern glaciers"), paper("doi:3", 4, title="Funsinfa caso antiguos"), paper("doi:4", 5),
        paper("doi:5", 6, title="Código fuente y glaciers"),
    ]
    stage = Stage(spark, "contained")
    r = stage.put(matching.records(papers(rows_)))
    r = r.drop("title").join(matching.weighed(r, "title", len(rows_), stage), "rid", "left")
    ids = r.select("rid", "canonical_id").collect()
    of = {x.rid: x.canonical_id for x in ids}
    got = {tuple(sorted((of[a], of[b]))) for a, b in rows(matching.contained_pairs(r))}
    assert got == {("arxiv:1", "doi:1"), ("arxiv:2", "doi:2"), ("doi:1", "doi:3")}


def test_title_with_longer_form_is_matched(spark, papers):
    filler = [paper(f"doi:f{i}", 10 + i, title=f"zq{i} xv{i} kj{i}") for i in range(60)]
    names_ = lambda *n: [{"name": x, "orcid": None} for x in n]
    short = paper("arxiv:1", 0, title="Código fuente lenguaje", year=2020, authors=names_("Daniel Feneaski"))
    longer = paper("doi:10.1/long", 1, title="Código fuente lenguaje: el caso de Funsinfa", year=2020, authors=names_("D. Fenemski"))
    got = rows(matching.match(papers([short, longer, *filler])).select("left_id", "right_id"))
    assert ("arxiv:1", "doi:10.1/long") in got


# --- 6: co-occurrence ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("heavy_items, heavy_from", [(0, 1), (5, 4), (1000, 1)])
def test_pair_counts_equal_brute_force(spark, heavy_items, heavy_from):
    rnd = random.Random(heavy_items)
    baskets = {f"b{i}": {f"i{int(rnd.paretovariate(0.9)) % 20:02d}" for _ in range(rnd.randint(0, 8))} for i in range(120)}
    df = spark.createDataFrame([(b, x) for b, xs in baskets.items() for x in xs], "basket string, item string")
    n = {x: sum(x in s for s in baskets.values()) for x in {x for s in baskets.values() for x in s}}
    want = []
    for a, b in itertools.combinations(sorted(n), 2):
        both = sum(a in s and b in s for s in baskets.values())
        if both >= 3 and max(n[a], n[b]) * 1.5 <= len(baskets):
            want.append((a, b, n[a], n[b], both))
    got = cooccurrence.pair_counts(df, len(baskets), 3, 1.5, heavy_items, heavy_from, 50, long_basket=3)
    assert rows(got.select("item_a", "item_b", "n_a", "n_b", "n_ab")) == sorted(want)


def test_popcounts():
    pdf = pd.DataFrame({"basket": [1, 1, 2, 2, 2, 3], "h": [0, 1, 0, 1, 2, 2]})
    assert sorted(cooccurrence.popcounts(pdf, 3).itertuples(index=False, name=None)) == [(0, 1, 2), (0, 2, 1), (1, 2, 1)]


def test_references_as_baskets(spark, papers):
    p = papers([paper("a", 1, references=["W1", " w1", None, "", "10.1/X"]), paper("a", 2, references=["https://doi.example/10.1/x"]), paper("b", 3), paper(None, 4, references=["W1"])])
    assert rows(cooccurrence.baskets_of_references(p)) == [("a", "10.1/x"), ("a", "w1")]


# --- 7: survivors --------------------------------------------------------------------------------------------


def prov(source, day, **conf):
    return [(source, "id", dt.datetime(2024, 1, day), conf, None)]


def test_survivors(spark, papers):
    good = "A full abstract that ends as it should."
    p = papers([
        paper("doi:1", 1, title="T", abstract="Cut off in the mid…", venue="N/A", year=2999, provenance=prov("crossref", 1, abstract="high", venue="high", year="high")),
        paper("openalex:1", 2, title="T", abstract=good, venue="J", year=2020, provenance=prov("OpenAlex ", 1, abstract=" Low", year="medium")),
        paper("arxiv:1", 3, title="T", abstract=good + " More.", venue="K", year=2021, provenance=prov("arxiv", 9, abstract="low", venue="low", year="medium")),
        paper("arxiv:1", 4, title="T", abstract=good + " More.", venue="K", year=2021, provenance=prov("arxiv", 9, abstract="low", venue="low", year="medium")),
        paper("s2:1", 5, title="The title again", abstract="The title again.", provenance=prov("semantic_scholar", 3, abstract="high")), paper("lonely", 6, abstract=good),
    ])
    g = spark.createDataFrame([("g", x) for x in ("doi:1", "openalex:1", "arxiv:1", "s2:1", "gone")] + [("h", "lonely"), ("h", "gone2")], "group_id string, record_id string")
    m = survivors.members(g, p)
    fields = {f: (f,) for f in ("abstract", "venue", "year")}
    assert rows(survivors.best_bundles(m, fields)) == [("g", "abstract", "openalex:1"), ("g", "venue", "arxiv:1"), ("g", "year", "openalex:1")]
    both = survivors.best_bundles(m, {"abstract": ("abstract",), "published": ("venue", "year")}, [("abstract", "published")])
    # openalex:1 gives the better abstract but no confidence for its venue: arxiv:1 is trusted more in all
    assert rows(both) == [("g", "abstract", "arxiv:1"), ("g", "published", "arxiv:1")]


def test_bundles_without_dependencies_are_searched(spark):
    """No candidate is chosen before the search: of every bundle all values come to it whose bound reaches the best record."""
    data = [("g", "r1", "x", None, 3, 1), ("g", "r2", "y", "p", 2, 2), ("g", "r3", "z", "q", 1, 1), ("g", "r4", "y", "q", 2, 3)]
    m = spark.createDataFrame(data, "group_id string, record_id string, a string, b string, trust_a int, trust_b int").withColumns({"source_rank": F.lit(1), "fetched_at": F.lit(None).cast("timestamp"), "ok_a": F.lit(True), "ok_b": F.col("b").isNotNull()})
    bundles = {"a": ("a",), "b": ("b",)}
    found = survivors.search_space(m, bundles).first()
    # r4 by itself is worth 3 + 4: of bundle a, x (4 + 4) and y (3 + 4, r2 before r4) may be as good, z (2 + 4) not; of b, p (3 + 4) and q (4 + 4)
    assert sorted((x["i"], x["record_id"]) for x in found["c"]) == [(0, "r1"), (0, "r2"), (1, "r2"), (1, "r4")]
    assert rows(survivors.best_bundles(m, bundles)) == [("g", "a", "r1"), ("g", "b", "r4")]


_record = st.tuples(*[st.one_of(st.none(), st.tuples(st.sampled_from(v), st.integers(1, 4), st.integers(0, 2))) for v in ("xyz", "pqr", "uvw")])


@given(st.lists(_record, min_size=1, max_size=6))
@settings(max_examples=80, deadline=None)
def test_branch_and_bound_equals_all_choices(records):
    """Each record has a value and a trust, or nothing, for three bundles; the second goes with the first, the third with the second."""
    seen: dict[tuple, tuple] = {}
    for k, rec in enumerate(records):
        for i, cell in enumerate(rec):
            if cell:
                v, t, u = cell
                seen[i, v] = min(seen.get((i, v), ((9,),)), ((-t, -u, 0), f"r{k}"))
    cand = [(i, v, r, *[-x for x in t]) for (i, v), (t, r) in seen.items()]
    pairs = {(i, i + 1, r[i][0], r[i + 1][0]) for r in records for i in (0, 1) if r[i] and r[i + 1]}
    got = survivors.branch_and_bound(cand, sorted(pairs), 3)
    stated = {p[:3] for p in pairs}
    options = [[None, *[(v, t, r) for (j, v), (t, r) in seen.items() if j == i]] for i in range(3)]
    best = None
    for choice in itertools.product(*options):
        if all(not (choice[i] and choice[i + 1]) or (i, i + 1, choice[i][0]) not in stated or (i, i + 1, choice[i][0], choice[i + 1][0]) in pairs for i in (0, 1)):
            cost = tuple(sum(c[1][k] for c in choice if c) for k in range(3))
            key = (cost, [c[2] if c else "\U0010ffff" for c in choice])
            best = min(best, key) if best else key
    assert [r or "\U0010ffff" for r in got] == best[1]


def test_bounded_candidates_keep_the_optimum(spark):
    """Bundles of random records: the columns' bound and the search give what all choices give."""
    rnd = random.Random(7)
    data = [(f"g{g}", f"r{g}-{k}", i, rnd.randint(0, 3), rnd.randint(1, 4), rnd.randint(0, 2), 0) for g in range(40) for k in range(rnd.randint(1, 6)) for i in (0, 1) if rnd.random() < 0.8]
    c = spark.createDataFrame(data, "group_id string, record_id string, i int, v long, c1 long, c2 long, c3 long")
    per_value = survivors._first(c, "group_id", "i", "v")
    kept = {tuple(r) for r in survivors.bounded(c, per_value).select("group_id", "i", "v").collect()}
    for g in sorted({d[0] for d in data}):
        own = [d for d in data if d[0] == g]
        cand = [tuple(r) for r in per_value.filter(F.col("group_id") == g).select("i", "v", "record_id", "c1", "c2", "c3").collect()]
        pairs = [(0, 1, a[3], b[3]) for a in own for b in own if a[1] == b[1] and a[2] == 0 and b[2] == 1]
        full = survivors.branch_and_bound(cand, pairs, 2)
        alive = [x for x in cand if (g, x[0], x[1]) in kept]
        ruled = [(x, y, vx, vy if (g, 1, vy) in kept else None) for x, y, vx, vy in pairs]
        assert survivors.branch_and_bound(alive, ruled, 2) == full


# --- 8: tokens -----------------------------------------------------------------------------------------------

TEXTS = ["", None, " ", "\n\n  a  \n", "It's we'll THEY'RE 'tis", "naïve café 北京 १२३ 𝔘𝔫𝔦 🙂🙂", "x" * 3000, "a b " * 4000, "<|endoftext|> text", "tab\tnbsp em zwsp​", "1234567 12.5% $x_y", "é combining", "line\r\nline\x0b\x0c\x85x"]


@pytest.fixture(scope="module")
def reference_encoding():
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("frequent", [3, 20000])
def test_ids_equal_the_tokenizer(spark, reference_encoding, frequent):
    docs = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (4, "another text", "x"), (None, "no id", "x")]
    got = rows(tokens.encode(spark.createDataFrame(docs, "doc_id long, text string, ids string"), frequent=frequent).select(F.coalesce("doc_id", F.lit(-1)), "ids"))
    want = sorted((-1 if i is None else i, ids) for i, ids in {(i, tuple(reference_encoding.encode_ordinary(t or ""))) for i, t, _ in docs})
    assert [(i, tuple(x)) for i, x in got] == want


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_sizes_equal_ids(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7])], "doc_id long, text string")
    n = {r.doc_id: r.n_tokens for r in tokens.sizes(docs, Stage(spark, "t"), frequent=5).collect()}
    assert n == {r.doc_id: len(r.ids) for r in tokens.encode(docs).collect()}


def test_no_documents(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- 9: packing ----------------------------------------------------------------------------------------------


def item_by_item(sizes, capacity):
    left, bins = [], 0
    for s in sorted(sizes, reverse=True):
        j = bisect.bisect_left(left, s)
        r = capacity if j == len(left) else left.pop(j)
        bins += j == len(left) and r == capacity
        if r - s:
            bisect.insort(left, r - s)
    return sorted(left)


@given(st.lists(st.integers(1, 30), max_size=60), st.integers(30, 40))
@settings(max_examples=200, deadline=None)
def test_best_fit_on_counts_equals_item_by_item(sizes, capacity):
    runs = packing.best_fit_decreasing({s: sizes.count(s) for s in set(sizes)}, capacity)
    load = {}
    for size, _, items, container, per in runs:
        for k in range(items):
            load[container + k // per] = load.get(container + k // per, 0) + size
    assert sum(load.values()) == sum(sizes) and all(x <= capacity for x in load.values())
    assert sorted(capacity - x for x in load.values() if x < capacity) == item_by_item(sizes, capacity)


@given(st.sets(st.integers(0, 20)), st.integers(0, 20))
@settings(max_examples=100, deadline=None)
def test_tree_finds_the_tightest(open_, size):
    t = packing.RemainingTree(20)
    for r in open_:
        t.set(r, True)
    assert t.tightest(size) == min((r for r in open_ if r >= size), default=-1)


def test_packing_of_documents(spark):
    sized = spark.createDataFrame([(i, n) for i, n in enumerate([5, 5, 5, 23, 0, 10, 9, 1, 1])] + [(None, 3)], "doc_id long, n_tokens long")
    out = packing.pack(sized, [("w", 10)], rank_groups=3).toPandas()
    assert out.groupby("container_no").piece_tokens.sum().max() <= 10 and out.piece_tokens.sum() == 62
    assert out[out.doc_id == 3].sort_values("piece_no").piece_tokens.tolist() == [10, 10, 3]
    assert out[out.piece_tokens > 0].container_no.nunique() == 7 and len(out) == 12
    assert packing.pack(sized.limit(0), [("w", 10)]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(sized, [("w", 0)])


# --- 10: subjects --------------------------------------------------------------------------------------------

TOPICS = {"law": ["court rulings", "asylum claims", "contract clauses", "tenancy law"], "sport": ["sprint times", "goal keepers", "rowing power", "relay teams"], "earth": ["river deltas", "plate boundaries", "coral reefs", "snow cover"]}


def made_text(rnd, topics, n=6):
    parts = []
    for i in range(n):
        t = rnd.choice(TOPICS[topics[i % len(topics)]]), rnd.choice(TOPICS[topics[i % len(topics)]])
        parts.append(rnd.choice(["Our findings suggest that {} depend on {}.", "No clear relation between {} and {} was found.", "Data on {} were gathered with {}."]).format(*t))
    return " ".join(parts) + " Tables and figures can be found at the end."


def test_subjects_of_made_documents(spark):
    rnd = random.Random(2)
    truth = [[rnd.choice(list(TOPICS))] if rnd.random() < 0.85 else rnd.sample(list(TOPICS), 2) for _ in range(260)]
    docs = [(i, made_text(rnd, t, 3 * len(t) + rnd.randint(0, 3))) for i, t in enumerate(truth)] + [(900, None), (901, " "), (902, "Tables and figures can be found at the end."), (903, "12 34")]
    labels = [(i, s) for i in range(90) for s in truth[i]] * 2 + [(5000, "law"), (3, "unknown")]
    got = rows(subjects.subjects_of(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string"), sorted(TOPICS)))
    want = {(i, s) for i, t in enumerate(truth) for s in t if i >= 90}
    held = {x for x in got if x[0] >= 90}
    assert len(held & want) / len(held) > 0.9 and len(held & want) / len(want) > 0.9
    assert not {x for x in got if x[0] >= 900}
    assert subjects.subjects_of(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, subject string"), ["law"]).count() == 0


def test_complement_weights_prefer_a_words_subject():
    w = subjects.complement_weights(np.array([[9.0, 0.0, 0.0], [3.0, 3.0, 3.0]]))
    assert w[0].argmax() == 0 and abs(w[1]).max() < abs(w[0]).max()


# --- all queries ---------------------------------------------------------------------------------------------


def test_queries_run_on_the_smallest_tables(spark):
    from citeloom.llm import queries

    for name in ("p2_found", "p5_found", "p7_found", "p9_containers", "p10_found"):
        assert queries.QUERIES[name](spark, SF).count() > 0, name


# --- clashing columns and empty tables -----------------------------------------------------------------------

CLASH = "key n a b t h f id ids rid grp unit label rank record_id group_id basket item word form o p g own w v x y e lang labels theta size".split()


def with_clashes(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns})


def operators():
    from citeloom.tables import table

    def found(s, d, wrap):
        t = lambda n: wrap(table(s, d, n))
        g = components.connected_components(components.accepted_links(t("feedback"), t("validation_audit")))
        return {
            "1": g,
            "2": names.variant_pairs(t("authors")),
            "5": matching.match(t("papers")).select("left_id", "right_id"),
            "6": cooccurrence.lifted_pairs(t("papers"), 2, 2).select("item_a", "item_b"),
            "7": survivors.best_bundles(survivors.members(g, t("papers")), {"abstract": ("abstract",), "published": ("venue", "year")}, [("abstract", "published")]),
            "8": tokens.encode(t("documents")),
            "9": packing.pack(tokens.sizes(t("documents"), Stage(s, "t")), [("w", 512)]),
            "10": subjects.subjects_of(t("documents"), t("subject_labels"), ["computing", "law", "physics"]),
        }

    return found


def test_clashing_columns_change_nothing(spark):
    found = operators()
    plain, clash = found(spark, SF, lambda df: df), found(spark, SF, with_clashes)
    for n, df in plain.items():
        assert clash[n].columns == df.columns, n
        assert sorted(map(str, clash[n].collect())) == sorted(map(str, df.collect())), n


def test_repeated_rows_change_nothing(spark):
    found = operators()
    plain, twice = found(spark, SF, lambda df: df), found(spark, SF, lambda df: df.unionByName(df))
    for n in ("1", "2", "6", "7", "8"):
        assert sorted(map(str, twice[n].distinct().collect())) == sorted(map(str, plain[n].distinct().collect())), n
    assert twice["8"].count() == plain["8"].count()


def test_empty_tables_give_empty_results(spark):
    for n, df in operators()(spark, SF, lambda df: df.limit(0)).items():
        assert df.count() == 0, n


def test_null_rows_do_no_harm(spark):
    """A row of nulls in every table gives no result of its own, but for the document without an id, which is kept."""

    def wrap(df):
        return df.unionByName(df.limit(1).select(*[F.lit(None).cast(kind).alias(c) for c, kind in df.dtypes]))

    found = operators()
    plain, nulls = found(spark, SF, lambda df: df), found(spark, SF, wrap)
    for n in ("1", "2", "5", "6", "7"):
        assert sorted(map(str, nulls[n].collect())) == sorted(map(str, plain[n].collect())), n
    assert nulls["8"].count() == plain["8"].count() + 1
    assert nulls["9"].count() == plain["9"].count() + 1
    assert nulls["10"].filter("doc_id is null").count() == 0
