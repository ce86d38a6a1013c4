from __future__ import annotations

import random

from sievework.operators import audits, discovery, search, taxonomy

SCHEMA = "asset bigint, title string, primary string, hubs array<string>, related array<string>, strong array<string>, broad array<string>, subjects array<string>, styles array<string>, seasons array<string>, pattern boolean, orientation string"


def plain_score(a, b):
    both = lambda c: len(set(a[c]) & set(b[c]))
    strong, need = both("strong"), min(2, len(a["strong"]))
    compound = need > 0 and strong >= need
    out = both("subjects") * 2_500_000 + len((set(a["hubs"]) - {a["primary"]}) & set(b["hubs"])) * 300_000 + strong * (900_000 if compound else 700_000) + 250_000 * compound
    out += both("styles") * 350_000 + both("seasons") * 300_000 + 200_000 * (a["pattern"] and b["pattern"]) + 75_000 * (a["primary"] in b["hubs"])
    out += sum((len(a["related"]) - i) * 10_000 for i, h in enumerate(a["related"]) if h in b["hubs"]) + both("broad") * 10_000 + 500 * (a["orientation"] == b["orientation"])
    return out


def plain_related(rows, k):
    out = set()
    for a in rows:
        found = []
        for b in rows:
            if a["asset"] != b["asset"] and (set(a["hubs"]) | set(a["related"])) & set(b["hubs"]):
                found.append((-plain_score(a, b), abs(a["asset"] - b["asset"]), b["asset"], b["title"]))
        first, rest, titles = [], [], set()
        for x in sorted(found):
            (rest if x[3] in titles else first).append(x)
            titles.add(x[3])
        out |= {(a["asset"], x[2], -x[0], i) for i, x in enumerate((first + rest)[:k], 1)}
    return out


def test_related_items_equal_brute_force_with_few_and_with_many_titles(spark):
    rng = random.Random(7)
    for n_titles in (3, 30):
        rows = []
        for i in rng.sample(range(100_000, 400_000), 160):
            hubs = sorted(rng.sample(["a", "b", "c", "d", "e"], rng.randint(1, 3)))
            strong = [f"t{rng.randrange(n_titles)}"]
            rows.append({"asset": i, "title": strong[0], "primary": hubs[0], "hubs": hubs, "related": rng.sample(["a", "b", "f"], rng.randint(0, 2)), "strong": strong, "broad": rng.choice([[], ["red"]]), "subjects": strong, "styles": [], "seasons": rng.choice([[], ["x"]]), "pattern": rng.random() < 0.2, "orientation": rng.choice("pl")})
        rows.append(rows[0] | {"asset": 5, "hubs": ["alone"], "primary": "alone", "related": []})
        got = {tuple(r) for r in discovery.related_items(spark.createDataFrame(rows, SCHEMA).repartition(3), 6).collect()}
        assert got == plain_related(rows, 6)
    assert discovery.related_items(spark.createDataFrame([], SCHEMA), 6).count() == 0


def test_related_items_of_dense_ids_and_without_titles(spark):
    """Neighbours at equal distances, a title that is null; the nearest are found without sorting all rows."""
    rng = random.Random(11)
    rows = []
    for i in range(80):
        word = f"t{rng.randrange(12)}"
        rows.append({"asset": i, "title": None if word == "t0" else word, "primary": "a", "hubs": ["a"], "related": [], "strong": [word], "broad": [], "subjects": [], "styles": [], "seasons": [], "pattern": False, "orientation": "p"})
    found = discovery.related_items(spark.createDataFrame(rows, SCHEMA).repartition(3), 6)
    assert {tuple(r) for r in found.collect()} == plain_related(rows, 6)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_greedy_promotion_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    cands = [(f"h{i}", float(rng.randrange(6))) for i in range(60)]
    pairs = [(a, b, rng.random()) for a, _ in cands for b, _ in cands if a < b and rng.random() < 0.08]
    both = pairs + [(b, a, r) for a, b, r in pairs]
    near = {(a, b) for a, b, r in both if r >= 0.4}
    for cap in (5, 100):
        kept, want = [], {}
        for h, _ in sorted(cands, key=lambda c: (-c[1], c[0])):
            blocked = any((h, x) in near for x in kept)
            want[h] = "redundant" if blocked else "selected" if len(kept) < cap else "over-cap"
            kept += [h] if want[h] == "selected" else []
        got = taxonomy.greedy_promotion(spark.createDataFrame(cands, "hub string, score double"), spark.createDataFrame(both, "hub string, other string, ratio double"), 0.4, cap)
        assert {r.hub: r.state for r in got.collect()} == want


def test_phrases_are_counted_once_a_row_and_keep_their_words(spark):
    rows = [(1, "s", ["a", "b", "a", "b"]), (2, "t", ["a", "b"]), (3, "s", ["the", "b"]), (4, None, None), (5, "s", [])]
    got = {(r.phrase, r.size, r.n, r.sources) for r in taxonomy.mined_phrases(spark.createDataFrame(rows, "id int, source string, tokens array<string>"), "id", "source", "tokens", ["the"], 2).collect()}
    assert got == {("a", 1, 2, 2), ("b", 1, 3, 2), ("a b", 2, 2, 2)}


def test_audits_on_nulls_and_empty_tables(spark):
    titles = spark.createDataFrame([(1, None), (2, ""), (3, "red red_ring (x.png"), (4, "Blue Ring")], "id int, t string")
    flags = {r.id: r.f for r in titles.select("id", audits.title_flags(titles["t"]).alias("f")).collect()}
    assert flags[1] == flags[2] == ["empty"] and flags[4] == [] and {"lower-start", "underscore", "extension", "open-bracket"} <= set(flags[3])
    hits = audits.all_hits(spark.createDataFrame([(1, "aXa.a\nAA"), (2, None), (3, "")], "id int, t string"), "id", "t", ["a", "."], 1, 3)
    assert sorted((r.id, r.needle, r.line_no, r.col, r.context) for r in hits.collect()) == [(1, ".", 1, 4, "a.a"), (1, "a", 1, 1, "aXa"), (1, "a", 1, 3, "Xa."), (1, "a", 1, 5, ".a"), (1, "a", 2, 1, "AA"), (1, "a", 2, 2, "AA")]
    none = spark.createDataFrame([], "file string")
    assert audits.bundle_findings(none, none, ["png"], "^x").count() == 0
    routes = spark.createDataFrame([("/a", True), ("/b", False)], "route string, indexable boolean")
    assert {(r.route, r.finding) for r in audits.route_findings(routes, spark.createDataFrame([("/b",), ("/b",), ("/c",)], "route string")).collect()} == {("/a", "missing"), ("/b", "not-indexable"), ("/b", "twice"), ("/c", "unknown")}


def test_items_of_equal_tokens_meet_collections_once(spark, monkeypatch):
    """2,000 items of four sets of tokens (one with a repeat): four sets meet the collections, and every item gets what a plain sum gives."""
    names = ["red ring", "ring bolt", "bolt bolt", "blue"]
    tokens = spark.createDataFrame([(i, w, "broad" if w in ("red", "blue") else "strong") for i in range(2000) for w in names[i % 4].split()], "asset bigint, token string, kind string")
    profiles = spark.createDataFrame([("a", "ring", "strong", 3), ("a", "red", "broad", 2), ("b", "bolt", "strong", 5)], "hub string, token string, kind string, members bigint")
    keyed, sets = search.token_sets(tokens)
    assert (keyed.count(), keyed.select("set").distinct().count(), sets.count()) == (2000, 4, 7)
    got = {(r.asset, r.hub): (r.s_members, r.s_tokens, r.b_members) for r in discovery.inventory_match(tokens, profiles).collect()}
    per = [{"a": (3, 1, 2)}, {"a": (3, 1, 0), "b": (5, 1, 0)}, {"b": (10, 2, 0)}, {}]
    assert got == {(i, h): x for i in range(2000) for h, x in per[i % 4].items()}
    scores = search.match_scores(tokens, profiles, spark.createDataFrame([("a", 4), ("b", 10)], "hub string, size bigint"))
    want = [{"a": 2.75}, {"a": 2.25, "b": 1.5}, {"b": 3.0}, {}]
    assert {(r.asset, r.hub): r.score for r in scores.collect()} == {(i, h): x for i in range(2000) for h, x in want[i % 4].items()}
    seen, plain = [], discovery._related_sets
    monkeypatch.setattr(discovery, "_related_sets", lambda items, *a: seen.append(items.count()) or plain(items, *a))
    items = tokens.select("asset").distinct().selectExpr("asset", "'a' as primary")
    empty = lambda schema: spark.createDataFrame([], schema)
    found = discovery.related_hubs(
        items, items.selectExpr("asset", "'b' as hub").where("asset % 2 = 0"), tokens, spark.createDataFrame([("a", 40), ("b", 100)], "hub string, size bigint"), empty("hub string, token string, kind string"), profiles,
        empty("primary string, hub string, relation string"), empty("primary string, hub string, common bigint"), empty("hub string, cluster string, preferred string"), 10, 1, 3)
    by = {r.asset: (r.hub, r["rank"]) for r in found.collect()}
    assert seen == [4] and by == {i: ("b", 1) for i in range(2000) if i % 2 == 0}


def test_phrase_cells_follow_the_words(spark):
    """Cells grow with the places of phrases; each phrase of enough places keeps its bit, and none of fewer."""
    import numpy as np

    none = np.array([], dtype=np.int64)
    assert [taxonomy._cells_for(n) for n in (0, 10**6, 10**8, 10**12)] == [1 << 22, 1 << 22, 1 << 27, 1 << 29]
    rows = spark.createDataFrame([([1, 2, 3],)] * 300 + [([i + 10, i + 11],) for i in range(0, 600, 2)], "words array<bigint>").repartition(3)
    bits = taxonomy._common_cells(rows, none, 10, 3, 1 << 22)
    on = {int(h) & ((1 << 22) - 1) for _, hashes, _ in taxonomy._grams(np.array([1, 2, 3]), np.zeros(3, dtype=np.int64), none, 3) for h in hashes}
    assert set(np.flatnonzero(np.unpackbits(bits)).tolist()) == on and len(on) == 6
