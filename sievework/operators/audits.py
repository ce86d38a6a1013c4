"""Acceptance, title, link, route and bundle audits, candidate decisions and policy tables: findings come back as rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import match_text, words
from sievework.operators.gates import membership_diff
from sievework.operators.tagging import codes


def acceptance(hubs: DataFrame, key: str, problems: Column, ladder: Sequence[tuple[str, Sequence[str]]], risky: Column) -> DataFrame:
    """Q10: (key, status, problems): the last status of ``ladder`` one of whose problems a hub has; without any, ``owner-review-needed`` if it is risky."""
    status = F.when(risky, "owner-review-needed").otherwise("accepted")
    for name, own in ladder:
        status = F.when(F.arrays_overlap(problems, F.array(*map(F.lit, own))), name).otherwise(status)
    return hubs.select(key, status.alias("status"), F.array_join(F.array_sort(problems), ",").alias("problems"))


def seo_entries(pages: DataFrame, key: str, title: str, description: str, body: str, opening: int, most: int) -> DataFrame:
    """Q11: (key, codes) of pages whose title or description isn't theirs alone, is missing, or whose body opens like more than ``most`` others."""
    alone = lambda c: F.count("*").over(Window.partitionBy(c))
    start = F.left(F.lower(F.coalesce(F.col(body), F.lit(""))), F.lit(opening))
    p = pages.select(key, title, description, start.alias("_start"))
    p = p.withColumns({"_t": alone(title), "_d": alone(description), "_s": alone("_start")})
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    found = codes({"no-title": empty(title), "repeated-title": ~empty(title) & (F.col("_t") > 1), "no-description": empty(description), "repeated-description": ~empty(description) & (F.col("_d") > 1), "boilerplate": F.col("_s") > most})
    return p.select(key, F.array_join(found, ",").alias("codes"))


def seo_summary(entries: DataFrame) -> DataFrame:
    """Q11: one row: pages, failed ones, and whether none failed."""
    failed = F.count_if(F.col("codes") != "")
    return entries.agg(F.count("*").alias("pages"), failed.alias("failed"), (failed == 0).alias("passed"))


def link_data_findings(links: DataFrame, routes: DataFrame, held_back: DataFrame, hubs: DataFrame) -> DataFrame:
    """Q12: (page, finding, target): links to no route or to held-back ones, pages without links, parents that aren't there; hubs: (page, parent)."""
    there = routes.select(F.col("page").alias("target")).distinct()
    broken = links.join(there, "target", "left_anti").select("page", F.lit("broken").alias("finding"), "target")
    held = links.join(held_back.select(F.col("page").alias("target")).distinct(), "target", "left_semi").select("page", F.lit("held-back").alias("finding"), "target")
    none = hubs.select("page").join(links.select("page").distinct(), "page", "left_anti").select("page", F.lit("no-links").alias("finding"), F.lit(None).cast("string").alias("target"))
    lost = hubs.where("parent is not null").join(hubs.select(F.col("page").alias("parent")), "parent", "left_anti").select("page", F.lit("no-parent").alias("finding"), F.col("parent").alias("target"))
    return broken.unionByName(held).unionByName(none).unionByName(lost)


def route_findings(routes: DataFrame, listed: DataFrame) -> DataFrame:
    """Q13: (route, finding): indexable routes that the sitemap leaves out, listed ones that aren't indexable or known, and those listed twice; routes: (route, indexable)."""
    n = listed.groupBy("route").agg(F.count("*").alias("n"))
    met = routes.join(n, "route", "full_outer")
    found = codes({"unknown": F.col("indexable").isNull(), "missing": F.coalesce("indexable", F.lit(False)) & F.col("n").isNull(), "not-indexable": ~F.coalesce("indexable", F.lit(True)) & F.col("n").isNotNull(), "twice": F.coalesce("n", F.lit(0)) > 1})
    return met.select("route", F.explode(found).alias("finding"))


def title_review(titles: DataFrame, key: str, title: str, suffix: str, wording: str) -> DataFrame:
    """Q18: (key, title, codes) of titles without their suffix, held by several rows, or that show file names or internal wording."""
    t = F.col(title)
    found = codes({"no-suffix": ~t.rlike(suffix), "duplicate": F.count("*").over(Window.partitionBy(F.lower(t))) > 1, "extension": t.rlike(r"(?i)\.(png|jpe?g|svg|pdf)\b"), "internal-wording": t.rlike(wording)})
    return titles.select(key, title, F.array_join(found, ",").alias("codes")).where("codes <> ''")


#: Rules for titles (fixed values): name, and the pattern that a faulty title matches.
TITLE_RULES = [
    ("empty", r"^\s*$"), ("short", r"^\S{1,3}$"), ("long", r"^.{90,}$"), ("lower-start", r"^[a-z]"), ("all-capitals", r"^[^a-z]*[A-Z]{4}[^a-z]*$"), ("repeated-word", r"(?i)\b(\w+)\s+\1\b"), ("double-space", r"\s{2,}"),
    ("underscore", "_"), ("digits-run", r"[0-9]{5,}"), ("extension", r"(?i)\.(png|jpe?g|svg|pdf)\b"), ("copy-mark", r"(?i)\b(copy|final|draft)\b"), ("open-bracket", r"\([^)]*$"), ("edge-mark", r"^[^\w(]|[,;:&-]$"), ("encoded", r"%[0-9A-Fa-f]{2}|&[a-z]+;"),
]


def title_flags(title: Column) -> Column:
    """F8: the names of the rules that a title breaks."""
    return codes({name: F.coalesce(title, F.lit("")).rlike(p) for name, p in TITLE_RULES})


def issue_action(issues: Column, grave: Sequence[str], light: Sequence[str]) -> tuple[Column, Column]:
    """(confidence, action) of a row from its issues."""
    has = lambda own: F.arrays_overlap(issues, F.array(*map(F.lit, own)))
    sure = F.when(has(grave), "low").when(F.size(issues) > 2, "low").when(has(light) | (F.size(issues) > 0), "medium").otherwise("high")
    return sure, F.when(has(grave), "manual").when(F.size(issues) > 2, "manual").when(F.size(issues) > 0, "rename").otherwise("keep")


def all_hits(docs: DataFrame, id_col: str, text_col: str, needles: Sequence[str], before: int, width: int) -> DataFrame:
    """(id, needle, line_no, col, context) of every hit of every needle, in any case; hits of one needle don't overlap."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    each = lines.select(id_col, "line_no", "line", F.explode(F.array(*map(F.lit, needles))).alias("needle"))
    each = each.withColumn("p", F.split(F.lower("line"), F.concat(F.lit(r"\Q"), F.lower("needle"), F.lit(r"\E")), -1)).where(F.size("p") > 1)
    gap = F.length("needle")
    hit = each.select(id_col, "line_no", "line", "needle", F.posexplode(F.slice("p", F.lit(1), F.size("p") - 1)).alias("k", "_piece"), "p")
    col = F.aggregate(F.slice("p", F.lit(1), F.col("k") + 1), F.lit(1), lambda acc, x: acc + F.length(x)) + F.col("k") * gap
    placed = hit.select(id_col, "needle", (F.col("line_no") + 1).alias("line_no"), col.alias("col"), "line")
    return placed.select(id_col, "needle", "line_no", "col", F.expr(f"substring(line, greatest(1, col - {before}), {width})").alias("context"))


def sync_findings(systems: Mapping[str, tuple[DataFrame, DataFrame]], key: str) -> DataFrame:
    """Q21: (system, key, status): per system what it lacks and what it has too much; systems: name -> (expected, actual)."""
    rows = [membership_diff(e, a, key).withColumn("system", F.lit(name)) for name, (e, a) in systems.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def bundle_findings(expected: DataFrame, found: DataFrame, allowed: Sequence[str], pattern: str) -> DataFrame:
    """Q22: (file, finding): files that lack, are too many, of a forbidden kind, held twice, or whose key is badly formed; both sides (file)."""
    diff = membership_diff(expected, found, "file").select("file", "status")
    n = found.groupBy("file").agg(F.count("*").alias("n"))
    kind = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    own = n.select("file", F.explode(codes({"twice": F.col("n") > 1, "forbidden-kind": ~kind.isin(*allowed), "bad-key": ~F.col("file").rlike(pattern)})).alias("status"))
    return diff.unionByName(own).select("file", F.col("status").alias("finding"))


def reclassified_by(rows: DataFrame, key: str, old: Mapping[str, Column], new: Mapping[str, Column]) -> DataFrame:
    """Q6: (key, before, after) of rows to which two sets of ordered rules give different classes; a class is its first rule that holds."""
    first = lambda rules: F.coalesce(F.get(codes(rules), F.lit(0)), F.lit("approved"))
    r = rows.select(key, first(old).alias("before"), first(new).alias("after"))
    return r.where("before <> after")


def inventory_evidence(hubs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(key, supported): does an intro share a word with its hub's title or with a member's title? hubs: (key, title, intro), members: (key, title)."""
    w = lambda c: words(match_text(F.col(c)))
    intro = hubs.select(key, F.explode(F.array_distinct(w("intro"))).alias("w"))
    held = hubs.select(key, F.explode(w("title")).alias("w")).unionByName(members.select(key, F.explode(w("title")).alias("w"))).distinct()
    yes = intro.join(held, [key, "w"], "left_semi").select(key).distinct().withColumn("_y", F.lit(True))
    return hubs.select(key).join(yes, key, "left").select(key, F.coalesce("_y", F.lit(False)).alias("supported"))


def content_summary(hubs: DataFrame, content: DataFrame, key: str, tier: str, text_col: str, forbidden: str, weak: int) -> DataFrame:
    """One row of counts: hubs without content, with content of another tier, repeated, forbidden, weak, or with a number written into the text."""
    c = content.select(key, F.col(tier).alias("_tier"), F.col(text_col).alias("_text"))
    met = hubs.select(key, tier).join(c, key, "left").withColumn("_n", F.count("*").over(Window.partitionBy(F.lower(F.trim("_text")))))
    t = F.col("_text")
    return met.agg(
        F.count("*").alias("hubs"), F.count_if(t.isNull()).alias("missing"), F.count_if(F.col(tier) != F.col("_tier")).alias("tier_mismatch"), F.count_if(t.isNotNull() & (F.col("_n") > 1)).alias("duplicate"),
        F.count_if(t.rlike(forbidden)).alias("forbidden"), F.count_if(F.length(t) < weak).alias("weak"), F.count_if(t.rlike(r"\b[0-9]+\s+[a-z]+")).alias("embedded_counts"),
    )


def collisions(rows: DataFrame, path: Column, key: str) -> DataFrame:
    """(path, n, first) of output paths that several records share."""
    return rows.groupBy(path.alias("path")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def gallery_export(items: DataFrame, outer: str, inner: str, key: str, warned: Column, k: int) -> DataFrame:
    """(outer, inner, n, warned, sample): counts per nested group and its ``k`` items of smallest hash; lists have a bound, counts don't."""
    h = F.sha2(F.col(key).cast("string"), 256)
    r = items.select(outer, inner, key, warned.alias("_w"), F.row_number().over(Window.partitionBy(outer, inner).orderBy(h, key)).alias("_rn"))
    sample = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_rn") <= k, F.col(key)))), ",")
    return r.groupBy(outer, inner).agg(F.count("*").alias("n"), F.count_if("_w").alias("warned"), sample.alias("sample"))


def member_order(members: DataFrame, hub: str, key: str, rules: Sequence[tuple[Column, int]]) -> DataFrame:
    """(hub, key, score, pos): members of a hub by the points of the rules that hold, then by key."""
    score = reduce(lambda a, b: a + b, (F.when(c, F.lit(n)).otherwise(0) for c, n in rules))
    s = members.select(hub, key, score.alias("score"))
    return s.withColumn("pos", F.row_number().over(Window.partitionBy(hub).orderBy(F.desc("score"), key)))


def covering_picks(rows: DataFrame, hub: str, key: str, priority: Sequence[str], quotas: Sequence[tuple[str, Column, int]], most: int) -> DataFrame:
    """(key, reason): the first row of each priority hub, then each flag's quota of rows not yet taken, then one row per hub in turn, ``most`` in all."""
    turn = F.row_number().over(Window.partitionBy(hub).orderBy(key))
    r = rows.select(hub, key, turn.alias("_turn"), *(c.alias(f"_f{i}") for i, (_, c, _) in enumerate(quotas)))
    picked = r.where(F.col(hub).isin(*priority) & (F.col("_turn") == 1)).select(key, F.lit("priority").alias("reason"), F.lit(0).alias("_step"))
    for i, (name, _, n) in enumerate(quotas):
        open_ = r.where(F.col(f"_f{i}")).join(picked.select(key), key, "left_anti").orderBy(key).limit(n)
        picked = picked.unionByName(open_.select(key, F.lit(name).alias("reason"), F.lit(i + 1).alias("_step")))
    fill = r.join(picked.select(key), key, "left_anti").orderBy("_turn", hub, key).limit(most)
    fill = fill.select(key, F.lit("fill").alias("reason"), (F.col("_turn") + len(quotas)).alias("_step"), F.col(hub).alias("_hub"))
    every = picked.withColumn("_hub", F.lit(None).cast(rows.schema[hub].dataType)).unionByName(fill)
    return every.orderBy("_step", "_hub", key).limit(most).select(key, "reason")


def term_hits(items: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, asset): items that hold a term as a word, or as a phrase of words with an optional plural; terms: (term, phrase).

    Phrases and texts meet over the phrase's first word (in both numbers), so
    no phrase is tried on every text.  The terms, a vocabulary, go to the
    texts.
    """
    w = items.select(F.col(id_col).alias("asset"), F.concat(F.lit(" "), F.array_join(words(match_text(F.col(text_col))), " "), F.lit(" ")).alias("_t"), F.explode(F.array_distinct(words(match_text(F.col(text_col))))).alias("w"))
    first = F.split_part("phrase", F.lit(" "), F.lit(1))
    t = terms.select("term", "phrase", F.explode(F.array_distinct(F.array(first, F.concat(first, F.lit("s"))))).alias("w"))
    met = w.join(F.broadcast(t), "w")
    hit = F.contains("_t", F.concat(F.lit(" "), "phrase", F.lit(" "))) | F.contains("_t", F.concat(F.lit(" "), "phrase", F.lit("s ")))
    return met.where(hit).select("term", "asset").distinct()


def long_tail(hits: DataFrame, hubs: DataFrame, least: int) -> DataFrame:
    """(term, n, closest, overlap, state): terms by the items that hold them, against the hub that holds most of these; hits: (term, asset), hubs: (hub, asset).

    Both sides have rows for assets, so neither is sent through the driver.
    """
    n = hits.groupBy("term").agg(F.count_distinct("asset").alias("n"))
    met = hits.distinct().join(hubs.select("hub", "asset").distinct().hint("merge"), "asset").groupBy("term", "hub").agg(F.count("*").alias("common"))
    best = met.groupBy("term").agg(F.max_by("hub", F.struct("common", F.col("hub"))).alias("closest"), F.max("common").alias("common"))
    c = n.join(best, "term", "left").withColumn("overlap", F.round(F.coalesce(F.col("common") / F.col("n"), F.lit(0.0)), 6))
    state = F.when(F.col("n") < least, "backlog").when(F.col("overlap") >= 0.9, "redundant").when(F.col("overlap") >= 0.6, "review").otherwise("promote")
    return c.select("term", "n", "closest", "overlap", state.alias("state"))


def extracted(docs: DataFrame, key: str, text_col: str, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(key, phrase, source, context): what each pattern's group finds; rules: (source, context, pattern)."""
    one = lambda s, c, p: F.transform(F.regexp_extract_all(text_col, F.lit(p), F.lit(1)), lambda x: F.struct(F.lower(F.trim(x)).alias("phrase"), F.lit(s).alias("source"), F.lit(c).alias("context")))
    found = docs.select(key, F.explode(F.flatten(F.array(*(one(*r) for r in rules)))).alias("p"))
    return found.select(key, "p.*").where("phrase <> ''")


def rolled_up(phrases: DataFrame, key: str, category: DataFrame) -> DataFrame:
    """(phrase, assets, categories, sources, context, contexts): the commonest context is the phrase's kind; category: (key, category)."""
    rows = phrases.join(category, key).distinct()
    by = rows.groupBy("phrase", "context").agg(F.count_distinct(key).alias("c"))
    kinds = by.groupBy("phrase").agg(F.min_by("context", F.struct(-F.col("c"), "context")).alias("context"), F.count("*").alias("contexts"))
    all_ = rows.groupBy("phrase").agg(F.count_distinct(key).alias("assets"), F.count_distinct("category").alias("categories"), F.count_distinct("source").alias("sources"))
    return all_.join(kinds, "phrase").select("phrase", "assets", "categories", "sources", "context", "contexts")


def decided(cands: DataFrame, existing: DataFrame, risky: str, generic: Sequence[str], trusted: Column, minimum: Column, sure: Column) -> DataFrame:
    """(phrase, decision, reason) by a ladder: risk, duplicate of an existing title in any word order, generic, evidence, threshold, confidence."""
    order = lambda c: F.array_join(F.array_sort(F.split(F.lower(c), " ")), " ")
    known = existing.select(order(F.col("title")).alias("_o")).distinct().withColumn("_known", F.lit(True))
    c = cands.withColumn("_o", order(F.col("phrase"))).join(known, "_o", "left")
    enough = F.col("assets") >= minimum
    steps = [
        (F.col("phrase").rlike(risky), "rejected", "risk"), (F.col("_known").isNotNull(), "rejected", "duplicate"), (F.col("phrase").isin(*generic), "rejected", "generic"), (~trusted & enough, "manual_review", "untrusted"), (~trusted, "backlog", "untrusted"),
        (enough & sure, "promote_candidate", "meets-threshold"), (enough, "manual_review", "ambiguous"), (F.col("assets") >= 6, "manual_review", "below-threshold"),
    ]
    decision, reason = (reduce(lambda acc, s: acc.when(s[0], s[i]), steps[1:], F.when(steps[0][0], steps[0][i])).otherwise(last) for i, last in ((1, "backlog"), (2, "too-little")))
    return c.select("phrase", "assets", decision.alias("decision"), reason.alias("reason"))


def risk_audit(decisions: DataFrame, risky: str) -> DataFrame:
    """One row: candidates with a risky word, how many of them were promoted, and whether none was."""
    hit = F.col("phrase").rlike(risky)
    promoted = F.count_if(hit & (F.col("decision") == "promote_candidate"))
    return decisions.agg(F.count("*").alias("candidates"), F.count_if(hit).alias("risky"), promoted.alias("promoted"), (promoted == 0).alias("passed"))


def sub_scores(cands: DataFrame) -> DataFrame:
    """T5: seven sub-scores and their weighted sum (steps and weights are fixed values); cands: (hub, n, categories, subjects, specific, overlap, duplicate)."""
    steps = lambda c, rules, low: reduce(lambda acc, r: acc.when(c >= r[0], r[1]), rules[1:], F.when(c >= rules[0][0], rules[0][1])).otherwise(low)
    clamp = lambda c, top: F.greatest(F.lit(0), F.least(F.lit(top), F.round(c).cast("int")))
    s = cands.withColumns({
        "depth": steps(F.col("n"), [(400, 20), (150, 17), (60, 13), (20, 8)], 2), "clarity": F.when(F.col("specific"), 16).otherwise(10) + F.when(F.col("categories") > 3, 2).otherwise(0),
        "unique": clamp(F.least(F.lit(20), F.col("subjects") * 2 + F.col("categories") * 2 + F.when(F.col("specific"), 4).otherwise(0)), 20), "overlap_risk": clamp(F.col("overlap") * 20, 20), "duplicate_risk": F.when(F.col("duplicate"), 20).otherwise(0),
    })
    s = s.withColumn("value", clamp((F.col("depth") + F.col("clarity")) / 2 + F.least(F.lit(4), F.col("categories")), 20))
    final = F.col("clarity") * 1.5 + F.col("depth") * 1.35 + F.col("unique") * 0.85 + F.col("value") * 1.4 - F.col("overlap_risk") * 0.7 - F.col("duplicate_risk") * 1.1
    return s.withColumn("final", clamp(final, 100))


def with_policy(hubs: DataFrame, membership: DataFrame, moves: DataFrame, parents: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hubs (hub, parent, indexable, n), membership (hub, asset)) after a policy.

    moves: (asset, hub, add) puts items into hubs or takes them out; parents: (hub, parent) overrides; decisions:
    (hub, indexable).  A hub that lost its last item isn't indexable, whatever the policy says.
    """
    out = moves.where("not add").select("hub", "asset")
    more = moves.where("add").select("hub", "asset")
    m = membership.select("hub", "asset").join(out, ["hub", "asset"], "left_anti").unionByName(more).distinct()
    n = m.groupBy("hub").agg(F.count("*").alias("n"))
    h = hubs.join(parents.withColumnRenamed("parent", "_p"), "hub", "left").join(decisions.withColumnRenamed("indexable", "_i"), "hub", "left").join(n, "hub", "left")
    keep = F.coalesce("_i", "indexable") & (F.coalesce("n", F.lit(0)) > 0)
    return h.select("hub", F.coalesce("_p", "parent").alias("parent"), keep.alias("indexable"), F.coalesce("n", F.lit(0)).alias("n")), m


def children_of(hubs: DataFrame, most: int) -> DataFrame:
    """(hub, children): the indexable hubs below each hub in order, at most ``most``."""
    c = hubs.where("indexable and parent is not null").select(F.col("parent").alias("hub"), F.col("hub").alias("child"))
    r = c.withColumn("_rn", F.row_number().over(Window.partitionBy("hub").orderBy("child"))).where(F.col("_rn") <= most)
    return r.groupBy("hub").agg(F.array_join(F.array_sort(F.collect_list("child")), ",").alias("children"))


def subpath_faults(items: DataFrame, kinds: Sequence[str], key: str, stem: str, generated: DataFrame) -> DataFrame:
    """(key, kind, expected, actual) wherever the file made of an item and kind isn't where it should be; generated: (key, kind, path)."""
    wanted = items.select(key, stem, F.explode(F.array(*map(F.lit, kinds))).alias("kind")).select(key, "kind", F.concat_ws("/", "kind", stem).alias("expected"))
    return wanted.join(generated, [key, "kind"], "left").where(~F.col("expected").eqNullSafe(F.col("path"))).select(key, "kind", "expected", F.col("path").alias("actual"))


def page_lists(lists: DataFrame, page: str, item: str, available: DataFrame, k: int) -> DataFrame:
    """(page, item, position): featured, then preview, then member items; the first place of each counts, items must exist, ``k`` a page; lists: (page, item, part, at)."""
    first = lists.groupBy(page, item).agg(F.min(F.struct("part", "at")).alias("_o")).join(available.select(item).distinct(), item, "left_semi")
    place = F.row_number().over(Window.partitionBy(page).orderBy("_o", item))
    return first.withColumn("position", place).where(F.col("position") <= k).select(page, item, "position")
