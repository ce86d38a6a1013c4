"""Queries over a site whose pages are written from the part table: hubs list items, items link back, to neighbours and to hubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import keys, text
from sievework.operators import linkgraph
from sievework.plans.registry import query
from sievework.session import cut, table

SITE = "https://site.example"
PAGE = 48
_SLUG = "replace(lower(p_brand), '#', '-')"
# every item page with its hub, place in it, neighbours and planted faults
_ITEMS = f"""i AS (SELECT p_partkey AS k, p_name, p_brand, p_type, '/' || {_SLUG} AS hub, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nxt FROM part),
r AS (SELECT *, '/item/' || k AS route, CASE WHEN pos <= {PAGE} THEN hub ELSE hub || '/page/' || CAST(ceil(pos / {PAGE}) AS BIGINT) END AS listed FROM i)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_brand", "p_type", F.concat(F.lit("/"), text.slug(F.col("p_brand"))).alias("hub"))
    w = Window.partitionBy("p_brand").orderBy("k")
    p = p.withColumn("pos", F.row_number().over(w)).withColumn("nxt", F.lead("k").over(w))
    return p.withColumn("route", F.concat(F.lit("/item/"), F.col("k").cast("string"))).withColumn("listed", keys.page_route(F.col("hub"), F.ceil(F.col("pos") / PAGE)))


def _link(href: Column, name: Column) -> Column:
    return F.concat(F.lit('<a href="'), href, F.lit('">'), name, F.lit("</a>"))


def _num(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def item_pages(rows: DataFrame) -> DataFrame:
    """Faults by key: each 7th breadcrumb says another brand in JSON-LD, each 11th has no canonical, each 13th relates to itself, each 17th to a page that isn't there, each 19th has a product of a forbidden type."""
    k = F.col("k")
    crumbs = F.concat(F.lit('<nav class="breadcrumb">'), _link(F.lit("/"), F.lit("Home")), _link(F.col("hub"), F.col("p_brand")), F.lit("</nav>"))
    said = F.when(k % 7 == 0, F.lit("Elsewhere")).otherwise(F.col("p_brand"))
    element = lambda n, name, url: F.concat(F.lit(f'{{"@type":"ListItem","position":{n},"name":"'), name, F.lit('","item":"'), url, F.lit('"}'))
    trail = F.concat(F.lit('{"@context":"https://schema.org","@type":"BreadcrumbList","itemListElement":['), element(1, F.lit("Home"), F.lit(f"{SITE}/")), F.lit(","), element(2, said, F.concat(F.lit(SITE), F.col("hub"))), F.lit("]}"))
    kind = F.when(k % 19 == 0, "Offer").otherwise("ImageObject")
    thing = F.concat(F.lit('{"@context":"https://schema.org","@type":"'), kind, F.lit('","url":"'), F.when(k % 23 == 0, F.col("route")).otherwise(F.concat(F.lit(SITE), F.col("route"))), F.lit('"}'))
    block = lambda c: F.concat(F.lit('<script type="application/ld+json">'), c, F.lit("</script>"))
    canonical = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit(f'<link rel="canonical" href="{SITE}'), F.col("route"), F.lit('">')))
    other = F.when(k % 13 == 0, F.col("route")).when(k % 17 == 0, F.concat(F.lit("/item/x"), _num("k"))).otherwise(F.concat(F.lit("/item/"), _num(F.coalesce("nxt", "k"))))
    related = F.concat(F.lit('<section class="related">'), _link(other, F.lit("next one")), F.lit("</section>"))
    footer = F.concat(F.lit("<footer>"), _link(F.concat(F.lit("/"), F.lower("p_type")), F.col("p_type")), F.lit("</footer>"))
    return rows.select("route", F.concat(F.lit("<html><head>"), canonical, block(trail), block(thing), F.lit("</head><body>"), crumbs, F.lit("<h1>"), F.col("p_name"), F.lit("</h1>"), related, footer, F.lit("</body></html>")).alias("html"))


def hub_pages(rows: DataFrame) -> DataFrame:
    """Listing pages of up to ``PAGE`` items; each 29th item isn't shown."""
    cards = rows.groupBy(F.col("listed").alias("route"), "p_brand", "hub").agg(F.array_sort(F.collect_list(F.when(F.col("k") % 29 != 0, F.struct("pos", "route", "p_name")))).alias("cards"))
    shown = F.array_join(F.transform("cards", lambda c: _link(c["route"], c["p_name"])), "")
    thing = F.concat(F.lit('<script type="application/ld+json">{"@context":"https://schema.org","@type":"ItemList","url":"'), F.lit(SITE), F.col("route"), F.lit('"}</script>'))
    return cards.select("route", F.concat(F.lit(f'<html><head><link rel="canonical" href="{SITE}'), F.col("route"), F.lit('">'), thing, F.lit('</head><body><h1>'), F.col("p_brand"), F.lit('</h1><main class="card-grid">'), shown, F.lit("</main></body></html>")).alias("html"))


def site(spark: SparkSession, sf: str) -> DataFrame:
    rows = items(spark, sf)
    return item_pages(rows).unionByName(hub_pages(rows))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    """The site's pages taken apart, written down once for all that a query reads of them."""
    return cut(linkgraph.parse_pages(site(spark, sf)))


_EDGES = f"""{_ITEMS}, e AS (SELECT route AS src, '/' AS dst, 'breadcrumb' AS region FROM r UNION ALL SELECT route, hub, 'breadcrumb' FROM r
UNION ALL SELECT route, CASE WHEN k % 13 = 0 THEN route WHEN k % 17 = 0 THEN '/item/x' || k ELSE '/item/' || coalesce(nxt, k) END, 'related' FROM r
UNION ALL SELECT route, '/' || lower(p_type), 'footer' FROM r UNION ALL SELECT listed, route, 'gallery-card' FROM r WHERE k % 29 <> 0), n AS (SELECT route FROM r UNION SELECT listed FROM r)"""


@query(f"WITH {_EDGES} SELECT region, count(*) AS n, count(DISTINCT dst) AS targets FROM e GROUP BY region")
def lg02_regions(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.anchors_of(parsed(spark, sf), SITE).groupBy("region").agg(F.count("*").alias("n"), F.count_distinct("target").alias("targets"))


@query(f"WITH {_EDGES} SELECT src, dst, count(*) AS n, bool_or(src <> dst) AS meaningful, bool_or(src <> dst AND region <> 'footer') AS content FROM e GROUP BY src, dst")
def lg07_site_edges(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.edges_of(linkgraph.anchors_of(parsed(spark, sf), SITE))


@query(f"WITH {_ITEMS} SELECT route AS page, unnest(list_filter([CASE WHEN k % 11 = 0 THEN 'no-canonical' END, CASE WHEN k % 31 = 0 THEN 'index-expected-noindex' END], lambda x: x IS NOT NULL)) AS finding FROM r")
def lg04_site_page_findings(spark: SparkSession, sf: str) -> DataFrame:
    expected = items(spark, sf).select(F.col("route").alias("page"), (F.col("k") % 31 != 0).alias("indexable"))
    return linkgraph.page_findings(parsed(spark, sf), expected, SITE)


@query(f"WITH {_EDGES} SELECT src AS page, 'self-link' AS finding, count(*) AS n FROM e WHERE src = dst GROUP BY 1")
def lg05_site_anchor_findings(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.anchor_findings(linkgraph.anchors_of(parsed(spark, sf), SITE)).groupBy("page", "finding").agg(F.count("*").alias("n"))


@query(f"""WITH {_EDGES}, c AS (SELECT dst, count(DISTINCT src) AS inbound, list(DISTINCT src) AS srcs FROM e WHERE region IN ('gallery-card', 'related', 'content') GROUP BY dst), m AS (SELECT DISTINCT dst FROM e WHERE src <> dst),
f AS (SELECT r.route AS item, list_filter([CASE WHEN c.dst IS NULL THEN 'no-content-inbound' END, CASE WHEN NOT coalesce(list_contains(c.srcs, r.listed), false) THEN 'no-hub-card' END, CASE WHEN m.dst IS NULL THEN 'orphan' END], lambda x: x IS NOT NULL) AS l FROM r LEFT JOIN c ON c.dst = r.route LEFT JOIN m ON m.dst = r.route)
SELECT item, unnest(l) AS finding FROM f""")
def lg12_item_inbound(spark: SparkSession, sf: str) -> DataFrame:
    p = parsed(spark, sf)
    wanted = items(spark, sf).select(F.col("route").alias("item"), F.col("listed").alias("hub_page"), "hub")
    return linkgraph.item_findings(wanted, p.select("page"), linkgraph.anchors_of(p, SITE), ["gallery-card", "related", "content"])


@query(f"WITH {_ITEMS} SELECT route AS page, 'Home>' || p_brand AS visible, 'Home>Elsewhere' AS structured FROM r WHERE k % 7 = 0")
def lg14_breadcrumbs(spark: SparkSession, sf: str) -> DataFrame:
    p = parsed(spark, sf)
    seen = linkgraph.visible_trails(linkgraph.anchors_of(p, SITE))
    return linkgraph.breadcrumb_findings(seen, linkgraph.structured_trails(p))


@query(f"WITH {_EDGES} SELECT src AS page, CASE WHEN src = dst THEN 'self-related' ELSE 'broken-related' END AS finding FROM e WHERE region = 'related' AND (src = dst OR dst NOT IN (SELECT route FROM n))")
def lg15_related_links(spark: SparkSession, sf: str) -> DataFrame:
    p = parsed(spark, sf)
    return linkgraph.related_findings(linkgraph.anchors_of(p, SITE), p.select("page"), 6)


@query(f"WITH {_ITEMS}, l AS (SELECT DISTINCT listed AS page FROM r), u AS (SELECT route AS page, CASE WHEN k % 19 = 0 THEN 'Offer' ELSE 'ImageObject' END AS type, route AS target FROM r WHERE k % 37 = 0 UNION ALL SELECT page, 'ItemList', page FROM l WHERE page LIKE '%/page/2') SELECT page, type, target FROM u")
def lg18_structured_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Against a list of known routes without each 37th item and without second pages."""
    p = parsed(spark, sf)
    known = items(spark, sf).where("k % 37 <> 0").select(F.col("route").alias("page")).unionByName(items(spark, sf).where("listed not like '%/page/2'").select(F.col("listed").alias("page")))
    return linkgraph.missing_targets(linkgraph.structured_types(p), known, SITE)


@query(f"""WITH {_ITEMS}, f AS (SELECT route AS page, list_filter([CASE WHEN k % 19 = 0 THEN 'forbidden-type' END, CASE WHEN k % 23 = 0 THEN 'relative-url' END, CASE WHEN k % 11 = 0 THEN 'no-canonical' END], lambda x: x IS NOT NULL) AS l FROM r) SELECT page, unnest(l) AS finding FROM f""")
def lg19_structured_checks(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.structured_findings(parsed(spark, sf), ["BreadcrumbList", "ImageObject", "ItemList"], ["Offer"], "https://schema.org")


@query(f"WITH {_EDGES}, d AS (SELECT DISTINCT src, dst FROM e) SELECT (SELECT count(*) FROM n) AS pages, (SELECT count(*) FROM e) AS anchors, (SELECT count(*) FROM d) AS unique_edges, (SELECT count(*) FROM d WHERE dst NOT IN (SELECT route FROM n)) AS broken, (SELECT count(*) FROM n WHERE route NOT IN (SELECT dst FROM d WHERE src <> dst)) AS orphans, false AS passed")
def lg17_site_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = parsed(spark, sf)
    return linkgraph.graph_summary(p.select("page"), linkgraph.resolved(p, SITE))


@query(f"WITH {_EDGES} SELECT src AS page, dst AS target, region, row_number() OVER (ORDER BY src, dst, region, i) - 1 AS position FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, region) AS i FROM e)")
def o03_sorted_edges(spark: SparkSession, sf: str) -> DataFrame:
    a = linkgraph.anchors_of(parsed(spark, sf), SITE)
    return linkgraph.numbered_evidence(a).select("page", "target", "region", "position")
