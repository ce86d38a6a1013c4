"""From pages of HTML to nodes, anchors, edges and findings.

``parse_pages`` is the one step in Python (a tokenizer over whole pages,
Arrow batches in and out); everything after it is joins and grouped counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.keys import resolver
from sievework.functions.markup import page_evidence
from sievework.functions.text import squeeze
from sievework.operators.records import positions
from sievework.operators.tagging import codes, first_match
from sievework.session import cut, cut_by, cut_round

#: Region names by what stands in an anchor's ancestors (fixed values).
REGIONS = [("breadcrumb", "breadcrumb"), ("pagination|pager", "pagination"), ("related", "related"), ("card|gallery|grid", "gallery-card"), (r"(^|\s)footer", "footer"), (r"(^|\s)(nav|header)|menu", "navigation")]


_ANCHOR = pa.struct([("position", pa.int32()), ("href", pa.string()), ("name", pa.string()), ("ancestors", pa.string()), ("nested", pa.bool_())])
PARSED = "page string, canonicals array<string>, robots string, h1 int, ids array<string>, json_ld array<string>, anchors array<struct<position:int,href:string,name:string,ancestors:string,nested:boolean>>"


def parse_pages(pages: DataFrame, page_col: str = "route", html_col: str = "html") -> DataFrame:
    """LG1: one row per page with its head evidence and its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                cols: dict[str, list] = {k: [] for k in ("canonicals", "robots", "h1", "ids", "json_ld", "anchors")}
                for html in some.column(1).to_pylist():
                    found = page_evidence(html or "")
                    for k, x in cols.items():
                        x.append([{"position": i, **a} for i, a in enumerate(found[k])] if k == "anchors" else found[k])
                types = [pa.list_(pa.string()), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(_ANCHOR)]
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(v, t) for v, t in zip(cols.values(), types, strict=True))], ["page", *cols])

    return pages.select(F.col(page_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, PARSED)


def anchors_of(parsed: DataFrame, site: str) -> DataFrame:
    """LG1, LG2: resolved anchors with their region; ``page`` is a route on ``site``."""
    a = parsed.select("page", F.explode("anchors").alias("a")).select("page", "a.*")
    a = a.withColumn("r", resolver(site)(F.col("href"), F.col("page")))
    return a.select("page", "position", "href", "name", "nested", first_match(F.col("ancestors"), REGIONS, "content").alias("region"), "r.*")


def resolved(parsed: DataFrame, site: str) -> DataFrame:
    """``anchors_of`` without names and addresses, written down once for all that a query reads of them."""
    return cut(anchors_of(parsed, site).select("page", "position", "region", "kind", "target", "fragment"))


def anchor_findings(anchors: DataFrame, generic: Sequence[str] = ("click here", "here", "more", "read more")) -> DataFrame:
    """LG5: (page, position, finding)."""
    low = F.lower(squeeze(F.col("name")))
    found = codes({
        "empty-name": F.coalesce(low, F.lit("")) == "", "generic-name": low.isin(*generic), "nested-anchor": F.col("nested"), "trailing-slash": F.col("had_trailing_slash"),
        "query-link": (F.col("kind") == "internal") & F.col("has_query"), "noncanonical-host": F.col("kind") == "noncanonical", "malformed": F.col("kind") == "malformed",
        "script-link": F.col("kind") == "javascript", "self-link": (F.col("kind") == "internal") & (F.col("target") == F.col("page")) & ~F.col("has_hash"), "empty-href": F.trim("href") == "",
    })
    return anchors.select("page", "position", F.explode(found).alias("finding"))


def edges_of(anchors: DataFrame) -> DataFrame:
    """LG7: unique internal (src, dst, n, meaningful, content): meaningful ones aren't self-links or from the sitemap, content ones not from navigation or footer."""
    e = anchors.where("kind = 'internal'").groupBy(F.col("page").alias("src"), F.col("target").alias("dst"))
    meaningful = (F.col("page") != F.col("target")) & (F.col("page") != "/sitemap")
    return e.agg(F.count("*").alias("n"), F.bool_or(meaningful).alias("meaningful"), F.bool_or(meaningful & ~F.col("region").isin("navigation", "footer")).alias("content"))


def link_findings(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """LG8: (page, target, finding) for links to unknown pages and to fragments that the target doesn't have."""
    n = nodes.select(F.col("page").alias("target"), F.lit(True).alias("_there"), "ids")
    met = anchors.where("kind = 'internal'").select("page", "target", "fragment").distinct().join(n, "target", "left")
    finding = F.when(F.col("_there").isNull(), "broken").when(F.col("fragment").isNotNull() & ~F.array_contains("ids", F.col("fragment")), "missing-fragment")
    return met.select("page", "target", finding.alias("finding")).where("finding is not null").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """LG9: (node, inbound, outbound) over unique edges without self-links."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.i").alias("inbound"), F.sum(1 - F.col("x.i")).alias("outbound"))


def click_depth(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """LG10: (node, depth) by breadth-first rounds: a frontier join, minus what was seen, until nothing is new.

    Edges are dealt by their source once, so a round shuffles its frontier
    alone.  Only a root or a node that several others link to can be reached
    again (``more``); the rest needs no look at what was seen.
    """
    start = cut(roots.select("node").distinct())
    e = edges.where("src <> dst").select("src", "dst").repartition("dst").distinct()
    several = F.count("*").over(Window.partitionBy("dst")) > 1
    e = e.withColumn("_several", several).join(start.select(F.col("node").alias("dst"), F.lit(True).alias("_root")), "dst", "left")
    e = cut_by(e.select("src", "dst", (F.col("_several") | F.col("_root").isNotNull()).alias("more")), "src")
    frontier = cut(start.select("node", F.lit(True).alias("more"), F.lit(0).alias("depth")))
    levels = [frontier]
    while True:
        # what was seen is the union of the tables written per depth; none of them is written again
        seen = reduce(lambda a, b: a.unionByName(b), levels)
        met = frontier.select("node").join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "more")
        known = seen.where("more").select("node")
        new = cut_round(met.distinct().join(known, "node", "left_anti").withColumn("depth", F.lit(len(levels))))
        if new.isEmpty():
            return seen.select("node", "depth")
        levels.append(new)
        frontier = new


def reach_findings(nodes: DataFrame, edges: DataFrame, depth: DataFrame, home: Column) -> DataFrame:
    """LG11: (node, finding): orphans, unreachable nodes, dead ends, nodes linked from the sitemap alone."""
    real = edges.where("src <> dst")
    into = real.groupBy(F.col("dst").alias("node")).agg(F.bool_and(F.col("src").cast("string") == "/sitemap").alias("only_map"))
    out = real.select(F.col("src").alias("node")).distinct().withColumn("_out", F.lit(True))
    n = nodes.join(into, "node", "left").join(out, "node", "left").join(depth.select("node", "depth"), "node", "left")
    found = codes({"orphan": F.col("only_map").isNull() & ~home, "unreachable": F.col("depth").isNull(), "only-via-sitemap": F.coalesce("only_map", F.lit(False)), "dead-end": F.col("_out").isNull()})
    return n.select("node", F.explode(found).alias("finding"))


def density(anchors: DataFrame, family: Column, k: int = 5) -> DataFrame:
    """Per route family: pages, anchors per page (median, p90, most), distinct targets, the pages with most anchors."""
    per = anchors.groupBy("page").agg(F.count("*").alias("n")).withColumn("family", family)
    ranked = per.withColumn("rn", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("n"), "page")))
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by n)")
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= k, F.struct("rn", "page")))), lambda x: x["page"]), " ")
    return ranked.groupBy("family").agg(F.count("*").alias("pages"), disc(0.5).alias("median"), disc(0.9).alias("p90"), F.max("n").alias("most"), top.alias("top"))


def page_findings(parsed: DataFrame, expected: DataFrame, site: str) -> DataFrame:
    """LG4: (page, finding): canonical missing, repeated or wrong; robots against ``expected`` (page, indexable)."""
    p = parsed.join(expected.select("page", "indexable"), "page", "left")
    noindex = F.coalesce(F.lower("robots").contains("noindex"), F.lit(False))
    first = F.get("canonicals", F.lit(0))
    found = codes({"no-canonical": F.size("canonicals") == 0, "many-canonicals": F.size("canonicals") > 1, "canonical-elsewhere": (F.size("canonicals") == 1) & (first != F.concat(F.lit(site), "page")),
                   "noindex-expected-index": noindex & F.coalesce("indexable", F.lit(False)), "index-expected-noindex": ~noindex & ~F.coalesce("indexable", F.lit(True)), "heading-count": F.col("h1") != 1})
    return p.select("page", F.explode(found).alias("finding"))


def structured_types(parsed: DataFrame) -> DataFrame:
    """LG18, LG19: (page, type, url) of each JSON-LD object's top level; a block that isn't JSON gives type ``invalid``."""
    blocks = parsed.select("page", F.explode("json_ld").alias("block"))
    v = blocks.select("page", F.try_parse_json("block").alias("v"))
    kind = F.when(F.col("v").isNull(), "invalid").otherwise(F.coalesce(F.try_variant_get("v", "$.@type", "string"), F.lit("none")))
    return v.select("page", kind.alias("type"), F.try_variant_get("v", "$.url", "string").alias("url"))


def visible_trails(anchors: DataFrame) -> DataFrame:
    """LG14: (page, trail): the names of a page's breadcrumb links in their order."""
    a = anchors.where("region = 'breadcrumb'").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("t"))  # a page's own links
    return a.select("page", F.transform("t", lambda x: x["name"]).alias("trail"))


def structured_trails(parsed: DataFrame) -> DataFrame:
    """LG14: (page, trail): the names of a page's structured breadcrumb list, by position."""
    element = "array<struct<position:int,name:string,item:string>>"
    blocks = parsed.select("page", F.explode("json_ld").alias("b")).where(F.get_json_object("b", "$['@type']") == "BreadcrumbList")
    t = blocks.select("page", F.array_sort(F.from_json(F.get_json_object("b", "$.itemListElement"), element)).alias("t"))
    return t.select("page", F.transform("t", lambda x: x["name"]).alias("trail"))


def breadcrumb_findings(visible: DataFrame, structured: DataFrame) -> DataFrame:
    """LG14: pages whose visible and structured breadcrumbs (page, trail array) differ, in order."""
    return visible.join(structured.withColumnRenamed("trail", "other"), "page", "full_outer").where(~F.col("trail").eqNullSafe(F.col("other"))).select("page", F.array_join("trail", ">").alias("visible"), F.array_join("other", ">").alias("structured"))


def related_findings(anchors: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """LG15: (page, finding): related links that repeat, point to their own page or to none, or are too many."""
    there = nodes.select(F.col("page").alias("target")).distinct().withColumn("_there", F.lit(True))
    r = anchors.where("region = 'related' and kind = 'internal'").groupBy("page", "target").agg(F.count("*").alias("n")).join(there, "target", "left")
    g = r.groupBy("page").agg(F.max("n").alias("again"), F.bool_or(F.col("target") == F.col("page")).alias("own"), F.bool_or(F.col("_there").isNull()).alias("broken"), F.count("*").alias("targets"))
    return g.select("page", F.explode(codes({"repeated-related": F.col("again") > 1, "self-related": F.col("own"), "broken-related": F.col("broken"), "too-many-related": F.col("targets") > most})).alias("finding"))


def item_findings(items: DataFrame, nodes: DataFrame, anchors: DataFrame, regions: Sequence[str]) -> DataFrame:
    """LG12: (item, finding): items without a page, a link from content, a card on their hub's page, any link at all, or a hub; items: (item, hub_page, hub)."""
    links = anchors.where("kind = 'internal'").select(F.col("page").alias("src"), F.col("target").alias("item"), F.col("region").isin(*regions).alias("content")).distinct()
    own = items.select("item", F.col("hub_page").alias("src")).withColumn("_own", F.lit(True))
    into = links.join(own, ["item", "src"], "left").groupBy("item").agg(F.bool_or("content").alias("content"), F.bool_or(F.col("content") & F.col("_own").isNotNull()).alias("card"), F.bool_or(F.col("src") != F.col("item")).alias("linked"))
    here = nodes.select(F.col("page").alias("item")).distinct().withColumn("_page", F.lit(True))
    hubs = nodes.select(F.col("page").alias("hub")).distinct().withColumn("_hub", F.lit(True))
    met = items.join(into, "item", "left").join(here, "item", "left").join(hubs, "hub", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    found = codes({"no-page": F.col("_page").isNull(), "no-content-inbound": no("content"), "no-hub-card": no("card"), "orphan": no("linked"), "no-hub-page": F.col("_hub").isNull()})
    return met.select("item", F.explode(found).alias("finding"))


def missing_targets(structured: DataFrame, nodes: DataFrame, site: str) -> DataFrame:
    """LG18: (page, type, target) of structured data whose address on ``site`` is no known page."""
    t = structured.where(F.col("url").startswith(site) | F.col("url").startswith("/")).withColumn("target", F.replace("url", F.lit(site), F.lit("")))
    return t.join(nodes.select(F.col("page").alias("target")).distinct(), "target", "left_anti").select("page", "type", "target")


def structured_findings(parsed: DataFrame, allowed: Sequence[str], forbidden: Sequence[str], context: str) -> DataFrame:
    """LG19: (page, finding): blocks that aren't JSON, have another context, a forbidden or unknown type, a relative address, or breadcrumb positions out of order; pages with data but no canonical."""
    field = lambda f: F.get_json_object("b", f"$['{f}']")
    places = F.from_json(F.get_json_object("b", "$.itemListElement"), "array<struct<position:int>>")
    kind = F.coalesce(field("@type"), F.lit("none"))
    b = parsed.select("page", F.size("canonicals").alias("canonicals"), F.explode("json_ld").alias("b"))
    found = codes({
        "not-json": F.try_parse_json("b").isNull(), "other-context": ~F.coalesce(field("@context"), F.lit("")).eqNullSafe(F.lit(context)), "forbidden-type": kind.isin(*forbidden), "unknown-type": ~kind.isin(*allowed, *forbidden),
        "relative-url": F.coalesce(~field("url").rlike("^https://"), F.lit(False)), "positions": (kind == "BreadcrumbList") & ~F.coalesce(F.transform(places, lambda x: x["position"]) == F.sequence(F.lit(1), F.size(places)), F.lit(False)),
        "no-canonical": F.col("canonicals") == 0,
    })
    return b.select("page", F.explode(found).alias("finding")).distinct()


def graph_summary(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """LG17: one row: pages, anchors, unique edges, edges to no page, pages that none links to, and whether the last two are none."""
    n, e = nodes.select("page").distinct(), cut(edges_of(anchors).select("src", "dst"))
    broken = e.join(n.select(F.col("page").alias("dst")), "dst", "left_anti").agg(F.count("*").alias("broken"))
    orphans = n.join(e.where("src <> dst").select(F.col("dst").alias("page")), "page", "left_anti").agg(F.count("*").alias("orphans"))
    sums = [n.agg(F.count("*").alias("pages")), anchors.agg(F.count("*").alias("anchors")), e.agg(F.count("*").alias("unique_edges")), broken, orphans]
    one = sums[0]
    for s in sums[1:]:  # one row each
        one = one.join(s)
    return one.withColumn("passed", (F.col("broken") == 0) & (F.col("orphans") == 0))


def numbered_evidence(anchors: DataFrame) -> DataFrame:
    """O3: anchors in a full order (page, target, region, href, place on the page), numbered part by part."""
    place = F.struct("page", "target", "region", "href", F.col("position").alias("at"))
    return positions(anchors.select(place.alias("key")), "key").select("key.*", F.col("position"))


def domains(pages: DataFrame, page_col: str, html_col: str, family: Column) -> DataFrame:
    """LG20: (host, families, pages): hosts that pages name, and in which families."""
    urls = F.regexp_extract_all(html_col, F.lit(r"https?://([A-Za-z0-9.-]+)"), F.lit(1))
    hosts = pages.select(F.col(page_col), family.alias("family"), F.explode(F.array_distinct(urls)).alias("host"))
    return hosts.groupBy(F.lower("host").alias("host")).agg(F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.count_distinct(page_col).alias("pages"))


def ancestor_paths(nodes: DataFrame) -> DataFrame:
    """(node, path, state): path from the root down to the node; state is ``ok``, ``cycle`` or ``dangling``.

    Paths double in each round: a node's known stretch is joined to the stretch
    of the node where it ends, so the rounds grow with the logarithm of the
    depth.  A stretch that holds as many nodes as there are and still has no
    end lies in a cycle; so does one that meets itself.
    """
    n = cut(nodes.select("node", "parent"))
    ends = n.select("node", F.array("node").alias("path"), F.col("parent").alias("next"))
    known = n.select(F.col("node").alias("next")).distinct().withColumn("_there", F.lit(True))
    state = F.when(F.col("next").isNull(), "ok").when(F.col("_there").isNull(), "dangling").when(F.array_contains("path", F.col("next")), "cycle")
    every = cut(ends.join(known, "next", "left").select("node", "path", "next", state.alias("state")))
    while not every.where("state is null").isEmpty():
        open_, done = every.where("state is null"), every.where("state is not null")
        up = every.select(F.col("node").alias("next"), F.col("path").alias("above"), F.col("next").alias("after"), F.col("state").alias("end"))
        met = open_.select("node", "path", "next").join(up, "next")
        again = F.arrays_overlap("path", "above") | F.array_contains("path", F.col("after"))
        met = met.select("node", F.when(again, F.col("path")).otherwise(F.concat("above", "path")).alias("path"), F.col("after").alias("next"), F.when(again, "cycle").otherwise(F.col("end")).alias("state"))
        every = cut_round(done.unionByName(met))
    return every.select("node", "path", "state")
