"""Lists and forests: ranks by pointer doubling, interval labels, consistency of parents and children."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.records import positions
from sievework.session import cut, cut_round


def list_ranks(links: DataFrame) -> DataFrame:
    """(node, last, steps): the end that following ``next`` leads to and how far it is; both null where it leads into a loop.

    ``links``: (node, next), one row a node; a ``next`` that is null or no node
    is an end.  Every round joins the table with itself and doubles what each
    node has followed, so rounds grow with the logarithm of the longest list.
    """
    nodes = links.select(F.col("node").alias("_known")).distinct()
    known = links.join(nodes, F.col("next") == F.col("_known"), "left")
    t = cut(known.select("node", F.coalesce("_known", "node").alias("at"), F.col("_known").isNotNull().cast("bigint").alias("steps"), F.col("_known").isNull().alias("done")))
    n, open_ = t.agg(F.count("*"), F.count_if(~F.col("done"))).first()
    for _ in range(n.bit_length() + 1):
        if not open_:
            break
        o = t.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("steps").alias("more"), F.col("done").alias("over"))
        moved = t.where("not done").join(o, "at").select("node", F.col("to").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("over").alias("done"))
        t = cut_round(t.where("done").unionByName(moved))
        still = t.where("not done").count()
        open_ = still
    return t.select("node", F.when(F.col("done"), F.col("at")).alias("last"), F.when(F.col("done"), F.col("steps")).alias("steps"))


def intervals(hubs: DataFrame, hub: str, parent: str) -> DataFrame:
    """(hub, root, enters, leaves): numbers of a tour of the forest, siblings in key order, roots one after another.

    A hub is an ancestor of another exactly if it enters before and leaves
    after it.  The tour is one list of two arcs a hub, ranked by doubling.  Hubs
    on or below a cycle have nulls; an unknown parent makes a root.
    """
    h = cut(hubs.select(F.col(hub).cast("string").alias("hub"), F.col(parent).cast("string").alias("parent")))
    up = cut(list_ranks(h.select(F.col("hub").alias("node"), F.col("parent").alias("next"))))
    ends = up.select(F.col("node").alias("hub"), F.col("last").alias("root"), "steps")
    rows = h.join(ends, "hub")
    good = rows.where("root is not null").withColumn("parent", F.when(F.col("steps") > 0, F.col("parent")))
    # the next sibling; roots are siblings of each other, in blocks whose ends meet
    sib = Window.partitionBy("parent").orderBy("hub")
    inner = good.where("parent is not null").withColumn("next", F.lead("hub").over(sib)).withColumn("first", F.row_number().over(sib) == 1)
    tops = good.where("parent is null").select("hub", "root", "parent", "steps", F.lit(None).cast("string").alias("next"), F.lit(False).alias("first"))
    inner = inner.select("hub", "root", "parent", "steps", "next", "first")
    every = cut(inner.unionByName(tops))
    child = every.where("first").select(F.col("parent").alias("hub"), F.col("hub").alias("child"))
    down, back = (lambda c: F.concat(F.lit("+"), c)), (lambda c: F.concat(F.lit("-"), c))
    arcs = every.join(child, "hub", "left").select("root", F.explode(F.array(
        F.struct(down(F.col("hub")).alias("node"), F.coalesce(down(F.col("child")), back(F.col("hub"))).alias("next")),
        F.struct(back(F.col("hub")).alias("node"), F.coalesce(down(F.col("next")), back(F.col("parent"))).alias("next")))).alias("a"))
    ranks = list_ranks(arcs.select("a.node", "a.next"))
    sizes = every.groupBy("root").agg((2 * F.count("*")).alias("size"))
    placed = every.select("hub", "root").join(sizes, "root")
    enter = ranks.where(F.col("node").startswith("+")).select(F.substring("node", 2, 1 << 30).alias("hub"), F.col("steps").alias("_in"))
    leave = ranks.where(F.col("node").startswith("-")).select(F.substring("node", 2, 1 << 30).alias("hub"), F.col("steps").alias("_out"))
    own = placed.join(enter, "hub").join(leave, "hub").select("hub", "root", (F.col("size") - F.col("_in") - 1).alias("enters"), (F.col("size") - F.col("_out") - 1).alias("leaves"))
    none = rows.where("root is null").select("hub", "root", F.lit(None).cast("bigint").alias("enters"), F.lit(None).cast("bigint").alias("leaves"))
    return own.unionByName(none)


def is_ancestor(a: str, b: str) -> F.Column:
    """Is the hub of struct ``a`` (root, enters, leaves) a proper ancestor of that of ``b``."""
    x, y = F.col(a), F.col(b)
    return (x["root"] == y["root"]) & (x["enters"] < y["enters"]) & (x["leaves"] > y["leaves"])


def family_findings(hubs: DataFrame, hub: str, parent: str, children: str) -> DataFrame:
    """(hub, other, finding): parents and lists of children held against each other.

    ``unknown-parent``, ``unknown-child``, ``other-parent`` (a listed child
    names another parent or none), ``unlisted-child`` (a child that its
    parent's list leaves out), ``listed-twice``, ``out-of-order`` (a child that
    stands after a greater one) and ``cycle`` (a hub on or below one).
    """
    h = cut(hubs.select(F.col(hub).cast("string").alias("hub"), F.col(parent).cast("string").alias("parent"), F.col(children).alias("list")))
    names = h.select("hub")
    listed = h.select("hub", F.posexplode("list").alias("at", "other"))
    listed = cut(listed.withColumn("other", F.col("other").cast("string")))
    has = h.select(F.col("hub").alias("other"), F.col("parent").alias("named"), F.lit(True).alias("there"))
    met = listed.join(has, "other", "left")
    told = lambda rows, code: rows.select("hub", "other", F.lit(code).alias("finding"))
    wanted = h.where("parent is not null").select(F.col("parent").alias("hub"), F.col("hub").alias("other"))
    before = F.max("other").over(Window.partitionBy("hub").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    loops = list_ranks(h.select(F.col("hub").alias("node"), F.col("parent").alias("next"))).where("last is null").select(F.col("node").alias("hub"), F.lit(None).cast("string").alias("other"))
    found = [
        told(h.where("parent is not null").select("hub", F.col("parent").alias("other")).join(names.select(F.col("hub").alias("other")), "other", "left_anti"), "unknown-parent"),
        told(met.where("there is null and other is not null"), "unknown-child"),
        told(met.where("there and not (named <=> hub)"), "other-parent"),
        told(wanted.join(names, "hub", "left_semi").join(listed.select("hub", "other"), ["hub", "other"], "left_anti"), "unlisted-child"),
        told(listed.groupBy("hub", "other").agg(F.count("*").alias("n")).where("n > 1"), "listed-twice"),
        told(listed.withColumn("before", before).where("other < before"), "out-of-order"),
        told(loops, "cycle"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def relations(pairs: DataFrame, hubs: DataFrame, hub: str, parent: str) -> DataFrame:
    """``pairs`` (left, right, …) with ``relation``: ``child`` (left is the right one's), ``parent``, ``siblings``, ``descendant``, ``ancestor``, ``other``.

    Farther relations are range tests on the forest's interval labels.
    """
    labels = cut(intervals(hubs, hub, parent).join(hubs.select(F.col(hub).cast("string").alias("hub"), F.col(parent).cast("string").alias("parent")), "hub"))
    side = lambda name: labels.select(F.col("hub").alias(name), F.struct("parent", "root", "enters", "leaves").alias(f"_{name}"))
    met = pairs.join(side("left"), "left", "left").join(side("right"), "right", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    code = F.when(yes(F.col("_left.parent") == F.col("right")), "child").when(yes(F.col("_right.parent") == F.col("left")), "parent").when(yes(F.col("_left.parent") == F.col("_right.parent")), "siblings")
    code = code.when(yes(is_ancestor("_right", "_left")), "descendant").when(yes(is_ancestor("_left", "_right")), "ancestor").otherwise("other")
    return met.withColumn("relation", code).select(*pairs.columns, "relation")


def route_plan(paths: DataFrame, slugs: DataFrame, root: str) -> DataFrame:
    """(hub, route, depth, position, finding): the plan of all routes in order, the root first, and what breaks it.

    A route is the slugs on the way from the root, which has ``/`` and none.
    ``second-root`` (a hub without a parent beside the root), ``cycle`` and
    ``dangling`` hubs have no route; a route that two hubs would have is
    ``route-taken`` for all but the smallest of them, and what hangs below one
    of these or below a hub without a slug is ``not-contiguous``.  paths: (node,
    path, state) as ``ancestor_paths`` gives them, slugs: (hub, slug).
    """
    p = paths.select(F.col("node").alias("hub"), "path", "state", F.col("path")[0].alias("top"))
    whole = p.where((F.col("state") == "ok") & (F.col("top") == root))
    steps = whole.select("hub", F.posexplode("path").alias("at", "step")).join(slugs.select(F.col("hub").alias("step"), "slug"), "step", "left")
    bare = F.coalesce(F.col("slug"), F.lit("")) == ""
    own = steps.groupBy("hub").agg(F.array_sort(F.collect_list(F.when(F.col("at") > 0, F.struct("at", "slug")))).alias("s"), F.count_if(bare & (F.col("at") > 0)).alias("bare"), F.max("at").alias("depth"))
    route = F.concat(F.lit("/"), F.array_join(F.transform("s", lambda x: x["slug"]), "/"))
    named = cut(own.where("bare = 0").select("hub", route.alias("route"), "depth"))
    first = named.groupBy("route").agg(F.min("hub").alias("owner"))
    taken = cut(named.join(first, "route").where("hub <> owner").select("hub"))
    broken = taken.unionByName(own.where("bare > 0").join(slugs.where(F.coalesce("slug", F.lit("")) == "").select("hub"), "hub").select("hub"))
    below = whole.select("hub", F.explode("path").alias("above")).where("hub <> above").join(broken.select(F.col("hub").alias("above")), "above").select("hub").distinct().withColumn("below", F.lit(True))
    met = p.select("hub", "state", "top").join(named, "hub", "left").join(taken.withColumn("taken", F.lit(True)), "hub", "left").join(below, "hub", "left")
    code = F.when(F.col("state") != "ok", F.col("state")).when(F.col("top") != root, "second-root").when(F.col("below"), "not-contiguous").when(F.col("taken"), "route-taken").when(F.col("route").isNull(), "no-slug")
    rows = cut(met.select("hub", F.when(code.isNull(), F.col("route")).alias("route"), F.when(code.isNull(), F.col("depth")).alias("depth"), code.alias("finding")))
    good = positions(rows.where("finding is null").select("route"), "route")
    return rows.join(good, "route", "left").select("hub", "route", "depth", "position", "finding")


def chain_findings(pages: DataFrame, links: DataFrame) -> DataFrame:
    """LG13: (chain, page, finding) of pages that are linked one to the next.

    ``pages``: (chain, page, number), every page that a chain should have, with
    its number from one; ``links``: (src, dst), the page links that were found.
    ``no-page`` (a link to a page that is in no chain), ``back-missing`` and
    ``next-missing``, ``fork`` (links to more than one later page), ``foreign``
    (a link to another chain), ``loop`` (following the pages' first later link,
    or any link of a page without one, leads round), ``gap`` (the last page
    isn't reached in as many steps as there are pages left).
    """
    p = cut(pages.select("chain", "page", "number"))
    sizes = p.groupBy("chain").agg(F.max("number").alias("size"))
    there = p.select(F.col("page").alias("dst"), F.col("chain").alias("to"), F.col("number").alias("k"))
    met = cut(p.select("chain", F.col("page").alias("src"), "number").join(links.select("src", "dst").distinct(), "src").join(there, "dst", "left"))
    own = met.where("to = chain")
    by = own.groupBy(F.col("src").alias("page")).agg(
        F.count_if(F.col("k") > F.col("number")).alias("later"), F.bool_or(F.col("k") == F.col("number") + 1).alias("next"), F.bool_or(F.col("k") == F.col("number") - 1).alias("back"),
        F.min_by("dst", F.struct(F.when(F.col("k") > F.col("number"), 0).when(F.col("k") == F.col("number") - 1, 2).otherwise(1), "k")).alias("to"),
        F.max(F.col("k") > F.col("number")).alias("on"), F.bool_or((F.col("k") < F.col("number") - 1) | (F.col("k") == F.col("number"))).alias("round"))
    rows = cut(p.join(sizes, "chain").join(by, "page", "left"))
    # a page follows its first later link; one without may only lead round
    follow = F.when(F.coalesce("on", F.lit(False)) | F.coalesce("round", F.lit(False)), F.col("to"))
    ranks = list_ranks(rows.select(F.col("page").alias("node"), follow.alias("next"))).withColumnRenamed("node", "page")
    last = p.select(F.col("page").alias("last"), F.col("number").alias("reached"), F.col("chain").alias("last_chain"))
    ended = rows.join(ranks, "page").join(last, "last", "left")
    told = lambda r, page, code: r.select("chain", F.col(page).alias("page"), F.lit(code).alias("finding"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    found = [
        told(met.where("to is null"), "src", "no-page"),
        told(met.where("to <> chain"), "src", "foreign"),
        told(rows.where((F.col("number") > 1) & ~yes("back")), "page", "back-missing"),
        told(rows.where((F.col("number") < F.col("size")) & ~yes("next")), "page", "next-missing"),
        told(rows.where("later > 1"), "page", "fork"),
        told(ended.where("last is null"), "page", "loop"),
        told(ended.where((F.col("number") == 1) & F.col("last").isNotNull() & ((F.col("reached") != F.col("size")) | (F.col("steps") != F.col("size") - 1))), "page", "gap"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def pagination_audit(wanted: DataFrame, nodes: DataFrame, anchors: DataFrame, cards: str = "gallery-card", pager: str = "pagination") -> DataFrame:
    """LG13: (chain, page, finding) of paged listings, from the anchors that their pages hold.

    ``wanted``: (chain, page, number, item), which item's route each page should
    show; ``nodes``: (page), the pages there are; ``anchors`` as ``anchors_of``
    gives them.  ``missing-pagination-page``, ``pagination-membership-mismatch``
    (a page's cards aren't its items), ``hub-membership-sequence-mismatch`` (all
    pages' cards aren't the listing's items), and ``chain_findings`` over the
    page links of the pages that are there.
    """
    want = cut(wanted.select("chain", "page", "number", "item").distinct())
    pages = cut(want.select("chain", "page", "number").distinct())
    there = pages.join(nodes.select("page").distinct(), "page", "left_semi")
    links = anchors.where(F.col("region") == pager).select(F.col("page").alias("src"), F.col("target").alias("dst"))
    shown = anchors.where(F.col("region") == cards).select("page", F.col("target").alias("item")).distinct().join(there, "page")
    gone = pages.join(there.select("page"), "page", "left_anti")
    both = want.join(there.select("page"), "page", "left_semi").select("chain", "page", "item", F.lit(1).alias("w")).unionByName(shown.select("chain", "page", "item", F.lit(2).alias("w")))
    pairs = both.groupBy("chain", "page", "item").agg(F.sum("w").alias("w"))
    differ = pairs.where("w <> 3").select("chain", "page").distinct()
    every = want.select("chain", "item", F.lit(1).alias("w")).unionByName(shown.select("chain", "item", F.lit(2).alias("w"))).distinct()
    sequence = every.groupBy("chain", "item").agg(F.sum("w").alias("w")).where("w <> 3").select("chain").distinct()
    first = pages.where("number = 1").select("chain", "page")
    told = lambda rows, code: rows.select("chain", "page", F.lit(code).alias("finding"))
    chains = chain_findings(pages, links).join(gone.select("page"), "page", "left_anti").select("chain", "page", "finding")
    out = told(gone, "missing-pagination-page").unionByName(told(differ, "pagination-membership-mismatch"))
    return out.unionByName(told(sequence.join(first, "chain"), "hub-membership-sequence-mismatch")).unionByName(chains)
