"""Claims, list ranks, forests, page chains, digest trees and concept places against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sievework.operators import chains, claims, concepts, digests, graph, linkgraph


def plain_claims(members):
    hubs: dict = {}
    for h, i in members:
        if h is not None and i is not None:
            hubs.setdefault(h, set()).add(i)
    out, taken = {}, set()
    for h in sorted(hubs, key=lambda h: (-len(hubs[h]), h)):
        free = sorted(hubs[h] - taken)
        if free:
            out[h] = free[0]
            taken.add(free[0])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_claims_equal_taking_turns(spark, seed):
    rng = random.Random(seed)
    members = [(f"h{min(int(rng.expovariate(0.1)), 30)}", rng.randrange([20, 200, 12, 60][seed])) for _ in range(300)] + [(None, 1), ("h1", None), ("lone", 3)]
    df = spark.createDataFrame(members, "hub string, item bigint")
    sizes = df.where("item is not null").groupBy("hub").agg(F.count_distinct("item").alias("n"))
    got = claims.claims(df.join(sizes, "hub"), "hub", "item", F.col("item"), F.struct(-F.col("n"), "hub"))
    assert {r.hub: r.item for r in got.collect()} == plain_claims(members)


def test_representatives_in_order(spark):
    members = spark.createDataFrame([("big", 1), ("big", 2), ("big", 9), ("mid", 1), ("mid", 2), ("low", 1)], "hub string, item bigint")
    rows = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False)], "item bigint, f boolean")
    run = lambda most: [(r.item, r.reason, r.hub) for r in claims.representatives(members, "hub", "item", F.col("item"), rows, F.col("f"), most).collect()]
    assert sorted(run(9)) == [(1, "hub", "big"), (2, "hub", "mid"), (3, "flagged", None), (4, "fill", None)]
    assert sorted(run(3)) == [(1, "hub", "big"), (2, "hub", "mid"), (3, "flagged", None)]
    assert claims.representatives(members.limit(0), "hub", "item", F.col("item"), rows.limit(0), F.col("f"), 5).count() == 0


def test_list_ranks(spark):
    links = [(f"a{i}", f"a{i + 1}") for i in range(70)] + [("a70", None), ("x", "nowhere"), ("p", "q"), ("q", "p"), ("s", "s"), ("t", "q")]
    got = {r.node: (r.last, r.steps) for r in chains.list_ranks(spark.createDataFrame(links, "node string, next string")).collect()}
    want = {f"a{i}": ("a70", 70 - i) for i in range(71)} | {"x": ("x", 0)} | {k: (None, None) for k in "pqst"}
    assert got == want
    assert chains.list_ranks(spark.createDataFrame([], "node string, next string")).count() == 0


def test_size_estimates_do_not_grow_with_the_rounds(spark):
    """The driver holds them as whole numbers: the digits of some 14 rounds filled its memory."""
    digits = lambda df: len(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().__str__())
    links = spark.range(600).select(F.col("id").alias("node"), F.when(F.col("id") < 599, F.col("id") + 1).alias("next"))
    ranks = chains.list_ranks(links)
    assert ranks.where("last = 599 and steps = 599 - node").count() == 600
    edges = links.where("next is not null").select(F.col("node").alias("src"), F.col("next").alias("dst"))
    parts = graph.connected_components(edges)
    assert parts.where("component = 0").count() == 600
    paths = linkgraph.ancestor_paths(links.withColumnRenamed("next", "parent"))
    assert paths.where("state = 'ok' and size(path) = 600 - node").count() == 600
    assert [digits(x) < 40 for x in (ranks, parts, paths)] == [True] * 3


def test_intervals_tell_ancestors(spark):
    rng = random.Random(5)
    parents = {f"n{i}": rng.choice([None, f"n{rng.randrange(max(1, i // 2))}"]) if i else None for i in range(60)} | {"y": "z", "z": "y", "w": "y", "lost": "gone"}
    df = spark.createDataFrame(list(parents.items()), "hub string, parent string")
    rows = {r.hub: r for r in chains.intervals(df, "hub", "parent").collect()}
    assert set(rows) == set(parents) and all(rows[k].root is None and rows[k].enters is None for k in "yzw")

    def above(b):
        out, at = set(), parents.get(b)
        while at in parents:
            out.add(at)
            at = parents[at]
        return out

    good = [k for k in parents if rows[k].root is not None]
    side = chains.intervals(df, "hub", "parent").where("root is not null").select("hub", F.struct("root", "enters", "leaves").alias("s"))
    pairs = side.withColumnsRenamed({"hub": "a", "s": "x"}).join(side.withColumnsRenamed({"hub": "b", "s": "y"}), chains.is_ancestor("x", "y"))
    assert {(r.a, r.b) for r in pairs.select("a", "b").collect()} == {(a, b) for b in good for a in above(b)}


def test_family_findings(spark):
    rows = [("r", None, ["a", "b", "b", "x"]), ("a", "r", ["c", "b"]), ("b", "r", None), ("c", "a", []), ("d", "a", []), ("e", "none", []), ("p", "q", ["q"]), ("q", "p", ["p"])]
    got = {tuple(r) for r in chains.family_findings(spark.createDataFrame(rows, "hub string, parent string, kids array<string>"), "hub", "parent", "kids").collect()}
    assert got == {("r", "b", "listed-twice"), ("r", "x", "unknown-child"), ("a", "b", "other-parent"), ("a", "b", "out-of-order"), ("a", "d", "unlisted-child"), ("e", "none", "unknown-parent"), ("p", None, "cycle"), ("q", None, "cycle")}


def test_chain_findings(spark):
    pages = [("c", f"c{i}", i) for i in range(1, 6)] + [("d", f"d{i}", i) for i in range(1, 4)] + [("one", "o1", 1)]
    links = [("c1", "c2"), ("c2", "c1"), ("c2", "c3"), ("c3", "c2"), ("c3", "c4"), ("c3", "c5"), ("c4", "c3"), ("c5", "c4"), ("c4", "gone"), ("d1", "d2"), ("d2", "d3"), ("d2", "d1"), ("d3", "d2"), ("d3", "d1"), ("d1", "c1")]
    got = {tuple(r) for r in chains.chain_findings(spark.createDataFrame(pages, "chain string, page string, number bigint"), spark.createDataFrame(links, "src string, dst string")).collect()}
    assert got == {("c", "c4", "no-page"), ("c", "c4", "next-missing"), ("c", "c3", "fork"), ("c", "c1", "gap"), ("d", "d1", "foreign"), ("d", "d1", "loop"), ("d", "d2", "loop"), ("d", "d3", "loop")}


def test_digest_trees(spark):
    rows = [(i, f"v{i % 7}" if i % 11 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "k bigint, v string")
    one, again = (digests.tree(d, ["k"], ["v"], 2) for d in (df, df.repartition(7)))
    assert digests.digest(one).collect() == digests.digest(again).collect()
    assert digests.changed_ranges(one, again, 2).count() == 0
    other = spark.createDataFrame([(k, "new" if k == 17 else v) for k, v in rows if k != 23] + [(23, ""), (900, "x"), (40, rows[40][1])], "k bigint, v string")
    found = digests.changed_ranges(one, digests.tree(other, ["k"], ["v"], 2), 2)
    want = {r.h for r in spark.createDataFrame([(k,) for k in (17, 23, 900, 40)], "k bigint").select(F.substring(F.md5(F.col("k").cast("string").cast("binary")), 1, 2).alias("h")).collect()}
    if rows[23][1] == "":
        want -= {None}
    assert {r.range for r in found.collect()} == want
    empty = digests.tree(df.limit(0), ["k"], ["v"], 2)
    assert digests.changed_ranges(empty, empty, 2).count() == 0 and digests.changed_ranges(empty, one, 2).agg(F.sum("n_after")).first()[0] == 500
    assert [(r.name, r.n) for r in digests.table_digests({"a": (df, ["k"], ["v"]), "b": (df.limit(0), ["k"], ["v"])}).orderBy("name").collect()] == [("a", 500), ("b", 0)]
    # a null is not an empty string
    a, b = (digests.tree(spark.createDataFrame([(1, v)], "k bigint, v string"), ["k"], ["v"], 1) for v in (None, ""))
    assert digests.changed_ranges(a, b, 1).count() == 1


@pytest.mark.parametrize("edges", [None, " ,"])
def test_term_places(spark, edges):
    terms = ["aa", "a", "naïve 漢", "", None, "b c", "c"]
    docs = [(1, "aaa a,b c naïve 漢字 naïve 漢"), (2, None), (3, ""), (4, "x" * 5000 + " b c " + "y" * 5000), (1, "c"), (None, "a")]
    want = []
    for i, t in docs:
        for term in {x for x in terms if x}:
            for at in range(len(t or "") - len(term) + 1):
                past = at + len(term)
                if t[at:past] == term and (edges is None or ((at == 0 or t[at - 1] in edges) and (past == len(t) or t[past] in edges))):
                    want.append((i, term, at, t[max(0, at - 20) : past + 20]))
    frame = spark.createDataFrame([(t,) for t in terms], "term string")
    for block in (4_000_000, 3):
        got = concepts.term_places(spark.createDataFrame(docs, "id bigint, text string"), frame, "id", "text", edges, block_chars=block)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_concept_evidence(spark):
    kinds = spark.createDataFrame([("pets", "cat"), ("pets", "dog"), ("cats", "cat"), ("none", "zebra"), (None, "cat"), ("nil", None)], "concept string, term string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["cat dog cat", "no", "dog", None, "cat"])], "id bigint, text string")
    got = {r.concept: r for r in concepts.concept_evidence(docs, kinds, "id", "text", 3, 2, edges=" ").collect()}
    assert {k: (r.hits, r.rows, r.terms, r.supported, [(x.id, x.start, x.term) for x in r.examples or []]) for k, r in got.items()} == {
        "pets": (5, 3, 2, True, [(0, 0, "cat"), (2, 0, "dog")]), "cats": (3, 2, 1, False, [(0, 0, "cat"), (4, 0, "cat")]), "none": (0, 0, 0, False, []), "nil": (0, 0, 0, False, [])}
