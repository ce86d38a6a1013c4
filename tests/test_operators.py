"""Golden cases, edge inputs and invariants."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import keys, text
from sievework.operators import audits, gates, linkgraph, neardup, overlap, sampling, search, tagging, taxonomy
from sievework.operators.graph import connected_components
from sievework.sources import files
from sievework.streaming import ledgers


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("value,expected", [("  Café: Mándala  ", "cafe mandala"), ("St. Patrick’s Day", "st patricks day"), ("st patricks-day", "st patricks day"), ("", ""), (None, None), ("漢字", "")])
def test_search_key(spark, value, expected):
    assert one(spark, text.search_key, value) == expected


def test_title_keys_and_singulars(spark):
    assert one(spark, text.title_key, "Ａ\u00a0 B’s – C") == "a b's - c"
    assert one(spark, text.loose_title_key, "A, b! (C)") == "a b c"
    for w, s in (("berries", "berry"), ("boxes", "box"), ("cats", "cat"), ("glass", "glass"), ("bus", "bus")):
        assert one(spark, text.singular_plain, w) == s
    assert one(spark, text.unrepeat, "Cat cat CAT dog dog cat") == "Cat dog cat"
    assert one(spark, lambda c: text.bounded_title(c, "!", 11), "one two three four") == "one two!"
    assert one(spark, lambda c: text.clean_stem(c, F.lit("Fall Back"), ["png"], {"colr": "color"}, 12), "Colr colr Png alpha beta.png") == "color-alpha"
    assert one(spark, lambda c: text.clean_stem(c, F.lit("Fall Back"), ["png"]), "png.png") == "fall-back"
    assert one(spark, lambda c: text.corrected_title(c, [("teh", "the")])["title"], "teh teh  cat") == "the cat"


def test_token_profile(spark):
    p = one(spark, lambda c: text.token_profile(c, ["animal"], ["free", "coloring", "page", "pages", "design"]), "Free Animals Alligators Coloring Pages: Design 2")
    assert (p.strong, p.broad) == (["alligator"], ["animal"])


def test_hashes_and_routes(spark):
    def fnv(s):
        h = 2166136261
        for ch in s.encode():
            h = (h ^ ch) * 16777619 & 0xFFFFFFFF
        return h

    for s in ("", "a", "foobar", "The quick brown fox"):
        assert one(spark, keys.fnv1a, s) == fnv(s)
    assert one(spark, lambda c: keys.page_route(F.lit("/x"), c), 1, "int") == "/x" and one(spark, lambda c: keys.page_route(F.lit("/x"), c), 3, "int") == "/x/page/3"
    for path, code in (("a/b.png", None), ("", "empty"), ("/a", "absolute"), ("a/../b", "parent"), ("a//b", "empty-part"), ("a b", "character"), ("C:/x", "absolute")):
        assert one(spark, keys.path_problem, path) == code


@pytest.mark.parametrize(
    "href,source,kind,target,slash",
    [
        ("/coloring-pages/animals/", "/", "internal", "/coloring-pages/animals", True), ("animals/page/2#gallery", "/coloring-pages/flowers", "internal", "/coloring-pages/animals/page/2", False),
        ("/a%20b?x=1", "/", "internal", "/a b", False), ("/files/a.pdf", "/", "file", "/files/a.pdf", False), ("mailto:a@b.c", "/", "mailto", None, False),
        ("https://other.example/x", "/", "external", "https://other.example/x", False), ("http://www.site.example/x", "/", "noncanonical", "http://www.site.example/x", False), (None, "/", "internal", "/", False),
    ],
)
def test_hrefs(spark, href, source, kind, target, slash):
    r = spark.createDataFrame([(href, source)], "h string, s string").select(keys.resolver("https://site.example")("h", "s").alias("r")).first().r
    assert (r.kind, r.target, r.had_trailing_slash) == (kind, target, slash)


PAGE = """<html><head><link rel="canonical" href="https://site.example/a"><script>var x="<a href='/no'>no</a>";</script><script type="application/ld+json">{"@type":"ItemList","url":"https://site.example/a"}</script></head>
<body><!-- <a href="/never">x</a> --><nav class="breadcrumb"><a href="/">Home</a></nav><h1 id="top">A</h1><div class="card"><a href="/b#x"><img alt="Bee"></a></div><a href="/missing">m</a><a href="/a#top">top</a><p <b>unterminated"""


def test_page_parsing(spark):
    pages = spark.createDataFrame([("/a", PAGE), ("/b", "<h1>B</h1><h1>C</h1>"), ("/c", None), ("/d", "")], "route string, html string")
    parsed = linkgraph.parse_pages(pages)
    a = {(r.page, r.href): r for r in linkgraph.anchors_of(parsed, "https://site.example").collect()}
    assert set(a) == {("/a", "/"), ("/a", "/b#x"), ("/a", "/missing"), ("/a", "/a#top")}
    assert a["/a", "/"].region == "breadcrumb" and a["/a", "/b#x"].region == "gallery-card" and a["/a", "/b#x"].name == "Bee"
    found = {(r.page, r.target, r.finding) for r in linkgraph.link_findings(linkgraph.anchors_of(parsed, "https://site.example"), parsed).collect()}
    assert found == {("/a", "/b", "missing-fragment"), ("/a", "/missing", "broken"), ("/a", "/", "broken")}
    expected = spark.createDataFrame([("/a", True), ("/b", True)], "page string, indexable boolean")
    f = {(r.page, r.finding) for r in linkgraph.page_findings(parsed, expected, "https://site.example").collect()}
    assert ("/b", "heading-count") in f and ("/b", "no-canonical") in f and not any(p == "/a" for p, _ in f)
    assert [(r.type, r.url) for r in linkgraph.structured_types(parsed).collect()] == [("ItemList", "https://site.example/a")]
    edges = linkgraph.edges_of(linkgraph.anchors_of(parsed, "https://site.example"))
    assert {(r.src, r.dst) for r in edges.where("meaningful").collect()} == {("/a", "/"), ("/a", "/b"), ("/a", "/missing")}


def test_paths_cycles_and_dangling_parents(spark):
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "nowhere"), ("s", "s")], "node string, parent string")
    got = {r.node: (r.path, r.state) for r in linkgraph.ancestor_paths(nodes).collect()}
    assert got["b"] == (["r", "a", "b"], "ok") and got["r"] == (["r"], "ok")
    assert got["x"][1] == got["y"][1] == got["s"][1] == "cycle" and got["z"][1] == "dangling" and len(got) == 7


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            u, v = sorted((find(a), find(b)))
            root[v] = u
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {x: find(x) for x in root}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_depth_and_reach(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 4), (1, 1)], "src bigint, dst bigint")
    depth = linkgraph.click_depth(e, spark.createDataFrame([(0,)], "node bigint"))
    assert {(r.node, r.depth) for r in depth.collect()} == {(0, 0), (1, 1), (2, 2)}
    nodes = spark.createDataFrame([(i,) for i in range(6)], "node bigint")
    f = {(r.node, r.finding) for r in linkgraph.reach_findings(nodes, e, depth, F.col("node") == 0).collect()}
    assert f == {(3, "orphan"), (5, "orphan"), (3, "unreachable"), (4, "unreachable"), (5, "unreachable"), (4, "dead-end"), (5, "dead-end")}


def test_ranked_search(spark):
    items = spark.createDataFrame([("b", "cat", "", "", "cat"), ("a", "cat garden", "", "", "cat garden"), ("c", "garden cat", "", "", "garden cat"), ("d", "dog", "", "cat", "dog cat"), ("e", "catalogue", "", "", "catalogue")], "key string, title string, label string, terms string, blob string")
    got = search.ranked(items, spark.createDataFrame([("cat",)], "query string"), 9).orderBy("rank").collect()
    assert [(r.key, r.match_class) for r in got] == [("b", 1), ("a", 2), ("c", 3), ("e", 4), ("d", 6)]


def test_seats_equal_the_greedy_loop(spark):
    rng = random.Random(4)
    sizes = {f"g{i}": rng.randint(0, 30) for i in range(7)}
    got = {r.k: r.seats for r in sampling.seats(spark.createDataFrame(list(sizes.items()), "k string, n int"), "k", "n", F.lit(1.0), 25).collect()}
    have = {k: 1 for k in sorted(sizes) if sizes[k]}
    while sum(have.values()) < 25:
        best = max((k for k in sorted(have) if have[k] < sizes[k]), key=lambda k: sizes[k] ** 0.5 / (have[k] + 1))
        have[best] += 1
    assert got == have


def test_round_robin_equals_the_cursor(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("abcd")) for i in range(40)]
    got = [r.id for r in sampling.round_robin(spark.createDataFrame(rows, "id int, b string"), "b", [F.asc("id")], [F.col("id")], 40).orderBy("position").collect()]
    buckets = {}
    for i, b in rows:
        buckets.setdefault(b, []).append(i)
    want = []
    while any(buckets.values()):
        for b in list(buckets):
            if buckets[b]:
                want.append(buckets[b].pop(0))
    assert got == want


def test_spread_pages_and_rotation(spark):
    rng = random.Random(2)
    rows = [(p, i, rng.choice("aab"), i) for p in ("x", "y") for i in range(30)]
    out = search.spread(spark.createDataFrame(rows, "page string, pos int, grp string, id int"), "page", "pos", "grp").collect()
    for p in ("x", "y"):
        shown = [r.grp for r in sorted((r for r in out if r.page == p), key=lambda r: r.shown)]
        left = shown[:]
        assert sorted(shown) == sorted(r[2] for r in rows if r[0] == p)
        for i in range(2, len(shown)):
            if shown[i] == shown[i - 1] == shown[i - 2]:
                assert set(left[i:]) == {shown[i]}
    pool = spark.createDataFrame([("h", i) for i in range(20)], "hub string, id bigint")
    a, b = (sorted((r.shown, r.key) for r in search.rotation(pool, "hub", "id", F.lit(s), 8).collect()) for s in (1, 2))
    assert len(a) == len(b) == 8 and a != b and len({k for _, k in a}) == 8
    first = next(search.mulberry(0))
    assert abs(first - 0.26642920868471265) < 1e-12


def test_greedy_promotion(spark):
    c = spark.createDataFrame([("a", 9.0), ("b", 8.0), ("c", 7.0), ("d", 6.0)], "hub string, score double")
    o = spark.createDataFrame([("b", "a", 0.95), ("a", "b", 0.95), ("c", "b", 0.99), ("b", "c", 0.99)], "hub string, other string, ratio double")
    got = {r.hub: r.state for r in taxonomy.greedy_promotion(c, o, 0.9, 2).collect()}
    assert got == {"a": "selected", "b": "redundant", "c": "selected", "d": "over-cap"}


def test_overlap_edges(spark):
    m = spark.createDataFrame([("root", i) for i in range(6)] + [("a", 1), ("b", 1), ("c", 1), ("c", 2), ("a", 1), (None, 3)], "hub string, asset int")
    p = {(r.left, r.right): r for r in overlap.pairs(overlap.without_roots(m.where("hub is not null"))).withColumn("w", overlap.warning_class()).collect()}
    assert set(p) == {("a", "b"), ("a", "c"), ("b", "c")} and p["a", "b"].w == "exact" and p["a", "c"].w == "contained"
    assert overlap.pairs(m.limit(0)).count() == 0


def test_gates(spark):
    d = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, v string")
    assert [(r.code, r.value, r.n) for r in gates.duplicates(d, {"v": F.col("v")}).collect()] == [("v", "a", 2)]
    assert gates.guarded(d, F.col("v").isNull(), 1).count() == 3 and gates.guarded(d, F.col("v").isNull(), 0).count() == 0
    checks = gates.budget_check(spark.createDataFrame([("x", 2.0)], "id string, measured double"), spark.createDataFrame([("x", 1.0), ("y", 5.0)], "id string, limit double"))
    assert gates.all_pass(checks).first().blockers == "x,y"
    for dark, want in ((0.001, 60.0), (0.4, 100.0)):
        s = spark.createDataFrame([(dark,)], "dark double").select(gates.run_score([(F.col("dark") < 0.005, 40), (F.col("dark") > 0.7, 35)]).alias("s")).first().s
        assert s == want


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    base = [[f"t{rng.randrange(60)}" for _ in range(rng.randint(5, 14))] for _ in range(30)]
    rows = [(i, rng.sample(b, len(b))[: len(b) - rng.randint(0, 2)]) for i, b in enumerate(base + base + base)]
    docs = spark.createDataFrame(rows, "id int, t array<string>")
    classes = neardup.token_classes(docs, "id", F.col("t"), 5)
    got = {(r.left, r.right): r.common for r in neardup.jaccard_pairs(classes, 0.68).collect()}
    reps = {r.id: set(r.tokens) for r in classes.collect() if r.id == r.class_id}
    want = {(a, b): len(x & y) for a, x in reps.items() for b, y in reps.items() if a < b and len(x & y) / len(x | y) >= 0.68}
    assert got == want and len(want) > 10


def test_design_numbers_of_a_large_group(spark):
    """More equal titles than the query's SQL has numbers for (it stops at 999): every row gets one, as by a plain loop."""
    rows = [(i, "one", i % 9 if i % 3 == 0 else None) for i in range(1, 2501)]
    held, want = set(), {}
    for i, _, prev in rows:
        if prev and prev not in held:
            held.add(prev)
            want[i] = prev
    free = (n for n in range(1, 3000) if n not in held)
    want |= {i: next(free) for i, _, _ in rows if i not in want}
    got = sampling.design_numbers(spark.createDataFrame(rows, "asset bigint, title string, prev int"), "asset", "title", "prev")
    assert {r.asset: r.design_number for r in got.collect()} == want


def test_tokens_that_no_other_set_begins_with_make_no_rows(spark):
    """Fifty sets of own tokens beside a pair: only what the pair shares early goes on to the join."""
    rows = [(i, [1000 * i + k for k in range(40)]) for i in range(50)] + [(50, list(range(10**6, 10**6 + 40))), (51, list(range(10**6 + 2, 10**6 + 42)))]
    sets = neardup._ordered(spark.createDataFrame(rows, "id bigint, tokens array<bigint>"))
    met = neardup._met_heads(sets, 0.68)
    assert {r.id for r in met.select("id").distinct().collect()} == {50, 51} and met.count() <= 2 * 13
    found = neardup.jaccard_pairs(spark.createDataFrame([(i, i, t) for i, t in rows], "id bigint, class_id bigint, tokens array<bigint>"), 0.68)
    assert [tuple(r)[:3] for r in found.collect()] == [(50, 51, 38)]


def test_near_pairs_of_crowded_tokens(spark):
    """Under tokens that many sets begin with, sets meet by two tokens: the same pairs, down to sets of one token, and fewer meetings."""
    rng = random.Random(5)
    base = [rng.sample(range(24), rng.randint(1, 14)) for _ in range(120)]
    rows = sorted({tuple(sorted(rng.sample(b, max(1, len(b) - rng.randint(0, 2))))) for b in base * 3})
    sets = spark.createDataFrame([(i, i, list(t)) for i, t in enumerate(rows)], "id int, class_id int, tokens array<bigint>")
    for least in (0.45, 0.76):
        want = {(i, j): len(set(x) & set(y)) for i, x in enumerate(rows) for j, y in enumerate(rows) if i < j and len(set(x) & set(y)) / len(set(x) | set(y)) >= least - 1e-9}
        for crowd in (1, 1 << 13):
            got = {(r.left, r.right): r.common for r in neardup.jaccard_pairs(sets, least, 2, crowd).collect()}
            assert got == want and len(want) > 10
    # 600 sets that all begin with tokens from a few; no two of them are near
    common = [[*rng.sample(range(200), 20), *(10**6 + 100 * i + k for k in range(3))] for i in range(600)]
    o = neardup._ordered(spark.createDataFrame(list(enumerate(common)), "id int, tokens array<bigint>"), 1)
    meetings = lambda crowd: (m := neardup._met_heads(o, 0.76, crowd)).groupBy("token", "size").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert meetings(5) < meetings(1 << 13) / 3


def test_words_in_one_pass(spark):
    from sievework.functions import text

    texts = ["It\u2019s  \u201cA-B\u201d\tC", "", None, "--", " x ", "\u00c9t\u00e9 \u212aelvin 'q' 7", "a\nb"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(text.match_words(F.col("t")).alias("one"), text.words(text.match_text(F.col("t"))).alias("three")).collect()
    assert [r.one for r in got] == [r.three for r in got] and got[0].one == ["its", "a", "b", "c"]


def test_files_round_trip_and_guards(spark, tmp_path):
    root = str(tmp_path)
    d = spark.createDataFrame([(1, 'a "quoted", text\nline'), (2, None)], "id int, t string")
    files.export_csv(d.limit(0), ["id", "t"], f"{root}/empty")
    assert spark.read.option("header", True).csv(f"{root}/empty").columns == ["id", "t"]
    files.replace_tree(d, f"{root}/out/t", root)
    assert files.read_optional(spark, f"{root}/out/t", d.schema).count() == 2 and files.read_optional(spark, f"{root}/none", d.schema).count() == 0
    for bad in (root, "/", f"{root}/../x", "/elsewhere/x"):
        with pytest.raises(ValueError):
            files.guard(bad, root)
    site = tmp_path / "site"
    (site / "a").mkdir(parents=True)
    (site / "index.html").write_text("<p>home</p>")
    (site / "a" / "index.html").write_text("<p>a</p>")
    (site / "b.html").write_text("<p>b</p>")
    assert sorted(r.route.rstrip("/") for r in files.read_crawl(spark, str(site)).collect()) == ["", "/a", "/b"]
    assert {r.file for r in files.inventory(spark, str(site)).collect()} == {"index.html", "b.html"}
    (tmp_path / "m.json").write_text('{"runId": "r1", "records": [{"id": 1}, {"id": 2}]}')
    from pyspark.sql import types as T

    assert files.read_manifest(spark, f"{root}/m.json", T.StructType([T.StructField("id", T.LongType())])).count() == 2


def test_ledgers(spark, tmp_path):
    e = spark.createDataFrame([(1, "a", 5, 1), (1, "a", 7, 2), (2, "b", 1, 3), (1, "a", 7, 4)], "u int, k string, ts int, v int")
    e.repartition(3).write.parquet(f"{tmp_path}/e.parquet")
    want = {(1, 4), (2, 3)}
    assert {(r.u, r.v) for r in ledgers.last_by_key(e, ["u", "k"], ["ts", "v"]).collect()} == want
    assert {(r.u, r.v) for r in ledgers.streamed_upserts(spark, f"{tmp_path}/e.parquet", ["u", "k"], ["ts", "v"]).collect()} == want
    log = spark.createDataFrame([(1, "done"), (2, "quarantined")], "u int, status string")
    assert {r.u for r in ledgers.still_open(e, log, "u", False).collect()} == {2} and ledgers.still_open(e, log, "u", True).count() == 0 and ledgers.still_open(e, log, "u", True, True).count() == 4


def test_tags_and_findings_on_nulls(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "A Red ring")], "id int, t string")
    rules = spark.createDataFrame([("red", "c", ["red"])], "id string, tag_group string, terms array<string>")
    assert {r.id: r.tags for r in tagging.rule_tags(d, rules, "id", "t").collect()} == {1: [], 2: [], 3: ["red"]}
    assert tagging.phrase_findings(d, spark.createDataFrame([("x", "red")], "id string, phrase string"), "id", "t").count() == 1


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_pairs_of_an_asset_in_many_hubs(spark, monkeypatch, kind):
    """Lists longer than a block, hubs that go on from batch to batch, repeated and null members."""
    monkeypatch.setattr(overlap, "BLOCK", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    rows = [(h, a) for a in range(12) for h in range(23) if (h * 7 + a) % (a + 1) < 3] + [(1, 0), (1, 0), (None, 0), (2, None)]
    m = spark.createDataFrame(rows, "hub bigint, asset bigint").withColumn("hub", F.col("hub").cast(kind))
    try:
        got = {(r.left, r.right): (r.common, r.left_size, r.right_size) for r in overlap.pairs(m).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    held = {}
    for h, a in set(rows):
        if h is not None:
            held.setdefault(str(h) if kind == "string" else h, set()).add(a)
    n = {(x, y): len((held[x] & held[y]) - {None}) for x in held for y in held if x < y}
    assert got == {(x, y): (k, len(held[x]), len(held[y])) for (x, y), k in n.items() if k}
    # pairs are counted where lists meet: only (asset, left) rows are shuffled, nothing is grouped by both sides
    plan = overlap._common(m.distinct())._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("hashpartitioning(left") == 1 and "hashpartitioning(left#" in plan and ", right#" not in plan.split("hashpartitioning(")[-1].split(")")[0]


def test_long_tail_sends_no_items_to_the_driver(spark):
    items = spark.range(1000).select(F.col("id").alias("asset"), F.lit("an old ring").alias("label"))
    terms = spark.createDataFrame([("ring", "old ring")], "term string, phrase string")
    hubs = spark.range(1000).select(F.lit("h").alias("hub"), F.col("id").alias("asset"))
    found = audits.term_hits(items, terms, "asset", "label")
    met = audits.long_tail(found, hubs, 10)
    assert [tuple(r) for r in met.collect()] == [("ring", 1000, "h", 1.0, "redundant")]
    sides = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert len(sides) == 1 and "rightHint=(strategy=broadcast)" in sides[0]
    joins = [x for x in met._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x and "asset" in x]
    assert joins and all("strategy=merge" in x for x in joins if "broadcast" not in x)


def test_click_depth_shuffles_frontiers_alone(spark, monkeypatch):
    """Cycles, self-links, repeated edges, roots that are linked to; no round shuffles the edges."""
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(5, 5), (5, 6), (5, 6), (None, 4), (4, None)] + [(100 + i, 101 + i) for i in range(6)]
    roots = [3, 8, 100, 100, 999]
    plans, real = [], linkgraph.cut_round
    monkeypatch.setattr(linkgraph, "cut_round", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.node: r.depth for r in linkgraph.click_depth(spark.createDataFrame(edges, "src bigint, dst bigint"), spark.createDataFrame([(r,) for r in roots], "node bigint")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want, at = {r: 0 for r in roots}, 0
    while front := [n for n, d in want.items() if d == at]:
        at += 1
        for x, y in edges:
            if x in front and y is not None and y not in want:
                want[y] = at
    assert got == want and max(want.values()) >= 6
    assert all("hashpartitioning(src" not in p for p in plans)


def test_ascii_texts_are_not_sent_to_python(spark):
    """The folding sees null for them; marks, ligatures, Hangul and marks alone come out as a plain loop gives them."""
    import unicodedata

    seen = lambda c: F.coalesce(c, F.lit("nothing"))
    rows = ["plain + a", "é", "e\u0301 \u0301", "ﬁ Å ①", "한글", "İ𝐀", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = df.select("i", text._beyond_ascii(F.col("t"), lambda c: F.concat(F.lit("<"), seen(c), F.lit(">"))).alias("sent"), text.strip_marks(F.col("t")).alias("m"), text.compatible(F.col("t")).alias("k")).orderBy("i").collect()
    assert [r.sent for r in got] == [t if t is None or t.isascii() else f"<{t}>" for t in rows]
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    assert [r.m for r in got] == [t and bare(t) for t in rows] and [r.k for r in got] == [t and unicodedata.normalize("NFKC", t) for t in rows]


def test_stuffing_shuffles_texts_not_words(spark):
    docs = spark.createDataFrame([(1, "aaaa " * 9 + "bbbb ccc"), (2, None), (3, "a b"), (1, "aaaa BBBB"), (4, ""), (None, "dddd")], "doc_id bigint, text string")
    found = tagging.stuffing(docs, "doc_id", "text", least=4, times=1)
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 10, 2), (None, 1, 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1


def test_long_sets_meet_by_several_tokens(spark):
    """Long sets that have one rare token in common each are not proposed, and no near pair of long ones is lost; a key's row is shuffled once."""
    rng = random.Random(9)
    rows = [[*rng.sample(range(10**6), 150), 10**7 + i // 2] for i in range(60)]
    for base in range(12):
        long = rng.sample(range(10**8, 10**9), rng.choice((33, 70, 140, 300)))
        gone = int(len(long) * 0.19 * rng.uniform(0.6, 1.1))
        rows += [long, [*long[gone:], *rng.sample(range(2 * 10**9, 3 * 10**9), gone)], long[: len(long) - gone]]
    sets = spark.createDataFrame([(i, i, t) for i, t in enumerate(rows)], "id int, class_id int, tokens array<bigint>")
    for crowd in (1, 1 << 13):
        want = {(i, j): len(set(x) & set(y)) for i, x in enumerate(rows) for j, y in enumerate(rows) if i < j and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.68 - 1e-9}
        assert {(r.left, r.right): r.common for r in neardup.jaccard_pairs(sets, 0.68, 1, crowd).collect()} == want and 12 < len(want) < 36
    # the plan that meets is one sort of one exchange: no second side
    seen = []
    real = neardup.cut_round
    neardup.cut_round = lambda df: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df))[1]
    try:
        neardup.jaccard_pairs(sets, 0.68).count()
    finally:
        neardup.cut_round = real
    assert seen[1].count("RepartitionByExpression") == 1 and "Join" not in seen[1]


@pytest.mark.parametrize("most", [50, 1 << 23])
def test_pairs_of_collections_are_counted_before_they_are_shuffled(spark, monkeypatch, most):
    """Collections of any kind, in lots of any size, against a plain count; assets of like collections send a row for each collection, not for each asset."""
    monkeypatch.setattr(overlap, "MOST_PAIRS", most)
    monkeypatch.setattr(overlap, "BLOCK", 7)
    rng = random.Random(4)
    held = {f"a{i}": rng.sample([f"h{100 * (i % 3) + k}" for k in range(30)], rng.randint(1, 25)) for i in range(300)}
    rows = [(h, a) for a, hs in held.items() for h in hs]
    want = {}
    for hs in held.values():
        for x in hs:
            for y in hs:
                if x < y:
                    want[x, y] = want.get((x, y), 0) + 1
    found = overlap.pairs(spark.createDataFrame(rows + rows[:50], "hub string, asset string").repartition(3))
    assert {(r.left, r.right): r.common for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_phrases_are_named_without_shuffling_texts(spark, monkeypatch):
    """Counts and names against plain ones, with a map of first rows so full that it lets through most; texts meet no join."""
    rng = random.Random(8)
    docs = [(i, f"s{i % 3}", [rng.choice(["the", "a", "b", "c", "d", f"w{rng.randrange(40)}"]) for _ in range(rng.randint(0, 30))]) for i in range(200)]
    want = {}
    for i, source, words in docs:
        for n in (1, 2, 3):
            for k in range(len(words) - n + 1):
                if words[k] != "the" and words[k + n - 1] != "the":
                    want.setdefault((" ".join(words[k : k + n]), n), set()).add((i, source))
    want = {(p, n, len(held), len({s for _, s in held})) for (p, n), held in want.items() if len(held) >= 4}
    for full in (False, True):
        if full:
            real = taxonomy._marked
            monkeypatch.setattr(taxonomy, "_marked", lambda pairs, cells: real(pairs, cells) | 255)
        found = taxonomy.mined_phrases(spark.createDataFrame(docs, "id int, source string, tokens array<string>").repartition(5), "id", "source", "tokens", ["the"], 4)
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want) > 50
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
