"""Evidence, relations, routes, intent and suffixes on small tables with ties, nulls and empty inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievework.operators import chains, gates, linkgraph, taxonomy


def test_full_evidence(spark):
    found = spark.createDataFrame([(1, "subject", "cat"), (2, "subject", "cat"), (2, "style", "big"), (3, "subject", "cat"), (3, "subject", "hat"), (3, "subject", "hat")], "asset bigint, dim string, term string")
    cands = spark.createDataFrame([("h:cat", "subject", "cat"), ("h:none", "subject", "none")], "hub string, dim string, term string")
    items = spark.createDataFrame([(1, "b", "f1"), (2, "a", "f2"), (3, None, "f3")], "asset bigint, category string, file string")
    got = {r.hub: r for r in taxonomy.full_evidence(found, cands, items, ["subject", "style"], 2, 5, 2).collect()}
    e = got["h:cat"]
    assert (e.categories, [tuple(x) for x in e.top_categories], [tuple(x) for x in e.subject], [tuple(x) for x in e.style], [tuple(x) for x in e.examples]) == (2, [("a", 1), ("b", 1)], [("cat", 3), ("hat", 1)], [("big", 1)], [(1, "f1"), (2, "f2")])
    assert got["h:none"].subject is None and got["h:none"].examples is None


def test_related_candidates(spark):
    terms = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y"), ("b", "y"), ("c", None), ("a", None)], "hub string, term string")
    categories = spark.createDataFrame([("a", "k"), ("c", "k")], "hub string, category string")
    members = spark.createDataFrame([(h, i) for h in "acd" for i in range(200)] + [("b", i) for i in range(19)], "hub string, asset bigint")
    got = sorted((r.hub, r.other, r.score, r["rank"]) for r in taxonomy.related_candidates(terms, categories, members, 2).collect())
    # 200 shared members give no more than eight points; b shares 19 with the others, which give none
    assert got == [("a", "b", 20, 1), ("a", "c", 10, 2), ("b", "a", 20, 1), ("c", "a", 10, 1), ("c", "d", 8, 2), ("d", "a", 8, 1), ("d", "c", 8, 2)]


def test_redundant_pairs_look_both_ways(spark):
    overlaps = spark.createDataFrame([("mix", "one", 92, 100, 300), ("one", "mix", 92, 300, 100), ("p", "q", 90, 100, 135), ("q", "p", 90, 135, 100), ("r", "s", 100, 100, 136), ("s", "r", 100, 136, 100)], "hub string, other string, common bigint, hub_size bigint, other_size bigint")
    kinds = spark.createDataFrame([(h, h == "mix") for h in ("mix", "one", "p", "q", "r", "s")], "hub string, combination boolean")
    assert {(r.hub, r.other) for r in taxonomy.redundant_pairs(overlaps, kinds).collect()} == {("mix", "one"), ("p", "q"), ("q", "p")}


def test_relations(spark):
    hubs = spark.createDataFrame([("r", None), ("a", "r"), ("b", "r"), ("c", "a"), ("x", "y"), ("y", "x")], "hub string, parent string")
    pairs = [("a", "r", "child"), ("r", "a", "parent"), ("a", "b", "siblings"), ("c", "r", "descendant"), ("r", "c", "ancestor"), ("b", "c", "other"), ("x", "y", "child"), ("x", "r", "other"), ("nowhere", "r", "other"), (None, "r", "other")]
    got = chains.relations(spark.createDataFrame([p[:2] for p in pairs], "left string, right string"), hubs, "hub", "parent")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(pairs, key=str)


def test_route_plan(spark):
    hubs = [("top", None), ("a", "top"), ("b", "a"), ("c", "a"), ("d", "c"), ("e", "top"), ("f", "e"), ("z", None), ("y", "z"), ("p", "q"), ("q", "p"), ("lost", "gone")]
    slugs = [("a", "aa"), ("b", "same"), ("c", "same"), ("d", "dd"), ("e", ""), ("f", "ff"), ("y", "yy")]
    paths = linkgraph.ancestor_paths(spark.createDataFrame(hubs, "node string, parent string"))
    got = {r.hub: (r.route, r.position, r.finding) for r in chains.route_plan(paths, spark.createDataFrame(slugs, "hub string, slug string"), "top").collect()}
    assert got == {"top": ("/", 0, None), "a": ("/aa", 1, None), "b": ("/aa/same", 2, None), "c": (None, None, "route-taken"), "d": (None, None, "not-contiguous"), "e": (None, None, "no-slug"), "f": (None, None, "not-contiguous"), "z": (None, None, "second-root"), "y": (None, None, "second-root"), "p": (None, None, "cycle"), "q": (None, None, "cycle"), "lost": (None, None, "dangling")}


def test_intent_evidence(spark):
    members = spark.createDataFrame([("cats", i) for i in range(4)] + [("none", 1)], "hub string, asset bigint")
    titles = spark.createDataFrame([(0, "Big CATS"), (1, None), (2, "dog")], "asset bigint, title string")
    slugs = spark.createDataFrame([("cats", "cats-for-the"), ("none", "the-of")], "hub string, slug string")
    got = {r.hub: (r.members, r.hits, r.share, r.evidence) for r in taxonomy.intent_evidence(members, titles, slugs, ["for", "the"]).collect()}
    assert got == {"cats": (4, 1, 0.25, "weak"), "none": (1, 0, 0.0, "no-token")}


def test_suffix_tally(spark):
    titles = [(3, "A: Design 2"), (1, "B: Design 11"), (2, "C Set 4"), (5, None), (4, "plain"), (6, "D 7")]
    df = spark.createDataFrame(titles, "k bigint, t string")
    got = {(r.pattern, r.suffix): (r.n, r.examples) for r in gates.suffix_tally(df, "k", "t", [("design", ": Design [0-9]+$"), ("set", "Set [0-9]+$"), ("number", "[0-9]+$")], 1).collect()}
    assert got == {("design", ": Design #"): (2, [1]), ("set", "Set #"): (1, [2]), ("none", ""): (2, [4]), ("number", "#"): (1, [6])}
    assert gates.suffix_tally(df.limit(0), "k", "t", [("n", "x")]).count() == 0 and df.agg(F.count("*")).first()[0] == 6
