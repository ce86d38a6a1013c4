"""Queries over page graphs, reachability, components and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import gates, linkgraph, overlap
from sievework.operators.graph import connected_components
from sievework.operators.tagging import first_match
from sievework.plans.curation import _PAIRS, membership
from sievework.plans.registry import query
from sievework.session import cut, table

SITE = "https://site.example"
FAMILIES = [("^/en/", "english"), ("^/de/", "german"), ("^/(fr|es)/", "romance")]
_NEXT = "e AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"
_ROUTE = r"regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', '')"
_ANCH = f"a AS (SELECT page_id, {_ROUTE} AS page, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS href FROM pages)"


def routes(spark: SparkSession, sf: str) -> DataFrame:
    """Pages under their routes; the page of the smallest id stands where several share a route."""
    p = table(spark, sf, "pages").withColumn("route", F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", ""))
    return p.groupBy("route").agg(F.min_by("html", "page_id").alias("html"), F.min("page_id").alias("page_id"))


def all_anchors(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").withColumn("route", F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", ""))
    return linkgraph.anchors_of(linkgraph.parse_pages(p), SITE)


def next_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from each part to the next one in the same order."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return e.where("dst is not null and src <> dst").distinct()


@query(f"WITH {_ANCH} SELECT page, href, count(*) AS n FROM a GROUP BY page, href")
def lg01_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return all_anchors(spark, sf).groupBy("page", "href").agg(F.count("*").alias("n"))


@query(rf"""WITH p AS (SELECT page_id, {_ROUTE} AS route FROM pages) SELECT CASE WHEN regexp_matches(route, '^/en/') THEN 'english' WHEN regexp_matches(route, '^/de/') THEN 'german' WHEN regexp_matches(route, '^/(fr|es)/') THEN 'romance' ELSE 'other' END AS family, count(*) AS pages, count(DISTINCT route) AS routes FROM p GROUP BY 1""")
def lg03_route_families(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").withColumn("route", F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", ""))
    return p.groupBy(first_match(F.col("route"), FAMILIES, "other").alias("family")).agg(F.count("*").alias("pages"), F.count_distinct("route").alias("routes"))


@query(rf"""WITH r AS (SELECT DISTINCT {_ROUTE} AS route FROM pages) SELECT 'no-canonical' AS finding, count(*) AS n FROM r UNION ALL SELECT 'index-expected-noindex', count(*) FILTER (length(route) % 2 <> 0) FROM r""")
def lg04_page_findings(spark: SparkSession, sf: str) -> DataFrame:
    parsed = linkgraph.parse_pages(routes(spark, sf))
    expected = parsed.select("page", (F.length("page") % 2 == 0).alias("indexable"))
    return linkgraph.page_findings(parsed, expected, SITE).groupBy("finding").agg(F.count("*").alias("n"))


@query(rf"""WITH p AS (SELECT {_ROUTE} AS page, html FROM pages), a AS (SELECT page, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>', 1)) AS href, unnest(regexp_extract_all(html, '<a [^>]*href="[^"]*"[^>]*>(.*?)</a>', 1)) AS name FROM p), n AS (SELECT page, href, lower(trim(regexp_replace(name, '<[^>]*>', '', 'g'))) AS name FROM a),
f AS (SELECT unnest(list_filter([CASE WHEN name = '' THEN 'empty-name' END, CASE WHEN name IN ('click here', 'here', 'more', 'read more') THEN 'generic-name' END, CASE WHEN href LIKE '_%/' THEN 'trailing-slash' END, CASE WHEN contains(href, '?') THEN 'query-link' END, CASE WHEN href LIKE 'javascript:%' THEN 'script-link' END, CASE WHEN href = page THEN 'self-link' END, CASE WHEN trim(href) = '' THEN 'empty-href' END], lambda x: x IS NOT NULL)) AS finding FROM n)
SELECT finding, count(*) AS n FROM f GROUP BY finding""")
def lg05_anchor_findings(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.anchor_findings(all_anchors(spark, sf)).groupBy("finding").agg(F.count("*").alias("n"))


@query(rf"""WITH r AS (SELECT DISTINCT {_ROUTE} AS page FROM pages), x AS (SELECT DISTINCT '/en/' || page_id AS page FROM pages) SELECT coalesce(r.page, x.page) AS page, CASE WHEN r.page IS NULL THEN 'missing' ELSE 'unexpected' END AS status FROM r FULL JOIN x ON r.page = x.page WHERE r.page IS NULL OR x.page IS NULL""")
def lg06_inventory_diff(spark: SparkSession, sf: str) -> DataFrame:
    expected = table(spark, sf, "pages").select(F.concat(F.lit("/en/"), F.col("page_id").cast("string")).alias("page"))
    return gates.membership_diff(expected, routes(spark, sf).select(F.col("route").alias("page")), "page")


@query(rf"""WITH {_ANCH}, k AS (SELECT DISTINCT page, regexp_replace(href, '/+$', '') AS target FROM a WHERE href LIKE '/%'), r AS (SELECT DISTINCT {_ROUTE} AS route FROM pages) SELECT page, target, 'broken' AS finding FROM k WHERE target NOT IN (SELECT route FROM r) AND NOT regexp_matches(target, '[.][^/]*$')""")
def lg08_broken_links(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").withColumn("route", F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", ""))
    parsed = cut(linkgraph.parse_pages(p))  # read twice, parsed once
    nodes = parsed.groupBy("page").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))  # pages of one route
    return linkgraph.link_findings(linkgraph.anchors_of(parsed, SITE), nodes)


@query(f"WITH {_NEXT} SELECT node, CAST(sum(i) AS BIGINT) AS inbound, CAST(sum(o) AS BIGINT) AS outbound FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node")
def lg09_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.degrees(next_parts(spark, sf))


@query(f"WITH RECURSIVE {_NEXT}, b(node, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 7) SELECT node, min(depth) AS depth FROM b GROUP BY node")
def lg10_click_depth(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.click_depth(next_parts(spark, sf), spark.createDataFrame([(0,)], "node bigint"))


_CHAIN = "e AS (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders), f AS (SELECT min_by(o_orderkey, (o_orderdate, o_orderkey)) AS node FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_custkey)"


@query(f"""WITH RECURSIVE {_CHAIN}, b(node) AS (SELECT node FROM f UNION SELECT e.dst FROM b JOIN e ON e.src = b.node WHERE e.dst IS NOT NULL)
SELECT o_orderkey AS node, 'orphan' AS finding FROM orders WHERE o_orderkey NOT IN (SELECT node FROM f) AND o_orderkey NOT IN (SELECT dst FROM e WHERE dst IS NOT NULL)
UNION ALL SELECT o_orderkey, 'unreachable' FROM orders WHERE o_orderkey NOT IN (SELECT node FROM b) UNION ALL SELECT src, 'dead-end' FROM e WHERE dst IS NULL""")
def lg11_orphans_and_dead_ends(spark: SparkSession, sf: str) -> DataFrame:
    """Orders linked to the customer's next one, from the first orders of one segment's customers."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders")
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    e = cut(o.select(F.col("o_orderkey").alias("src"), after.alias("dst")).where("dst is not null"))
    chosen = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    roots = cut(o.join(chosen, "o_custkey").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("node")).select("node"))
    nodes = o.select(F.col("o_orderkey").alias("node")).join(roots.withColumn("root", F.lit(True)), "node", "left")
    return linkgraph.reach_findings(nodes, e, linkgraph.click_depth(e, roots), F.col("root").isNotNull())


@query(rf"""WITH p AS (SELECT {_ROUTE} AS route, page_id, lower(unnest(regexp_extract_all(html || ' ' || url, 'https?://([A-Za-z0-9.-]+)', 1))) AS host FROM pages), f AS (SELECT *, CASE WHEN regexp_matches(route, '^/en/') THEN 'english' WHEN regexp_matches(route, '^/de/') THEN 'german' WHEN regexp_matches(route, '^/(fr|es)/') THEN 'romance' ELSE 'other' END AS family FROM p)
SELECT host, string_agg(DISTINCT family, ',' ORDER BY family) AS families, count(DISTINCT page_id) AS pages FROM f GROUP BY host""")
def lg20_third_party_hosts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").withColumn("route", F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", "")).withColumn("both", F.concat_ws(" ", "html", "url"))
    return linkgraph.domains(p, "page_id", "both", first_match(F.col("route"), FAMILIES, "other"))


@query(rf"""WITH {_ANCH}, n AS (SELECT page, count(*) AS n FROM a GROUP BY page), f AS (SELECT *, CASE WHEN regexp_matches(page, '^/en/') THEN 'english' WHEN regexp_matches(page, '^/de/') THEN 'german' WHEN regexp_matches(page, '^/(fr|es)/') THEN 'romance' ELSE 'other' END AS family FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, page) AS rn FROM f)
SELECT family, count(*) AS pages, list_sort(list(n))[CAST(ceil(count(*) * 0.5) AS INT)] AS median, list_sort(list(n))[CAST(ceil(count(*) * 0.9) AS INT)] AS p90, max(n) AS most, string_agg(page, ' ' ORDER BY rn) FILTER (rn <= 5) AS top FROM r GROUP BY family""")
def a22_link_density(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.density(all_anchors(spark, sf), first_match(F.col("page"), FAMILIES, "other"))


@query(f"""WITH RECURSIVE {_PAIRS}, k AS (SELECT "left" AS a, "right" AS b FROM p WHERE jaccard >= 0.8 UNION SELECT "right", "left" FROM p WHERE jaccard >= 0.8), t(node, root) AS (SELECT a, a FROM k UNION SELECT k.b, t.root FROM t JOIN k ON k.a = t.node) SELECT node, min(root) AS component FROM t GROUP BY node""")
def d05_overlap_groups(spark: SparkSession, sf: str) -> DataFrame:
    near = overlap.pairs(membership(spark, sf)).where("jaccard >= 0.8")
    return connected_components(near, "left", "right")


@query("""SELECT 'S' || s_suppkey AS node, 'R' || n_regionkey || '>N' || n_nationkey || '>S' || s_suppkey AS path, 'ok' AS state FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey || '>N' || n_nationkey, 'ok' FROM nation UNION ALL SELECT 'R' || r_regionkey, 'R' || r_regionkey, 'ok' FROM region""")
def g05_breadcrumbs(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s = table(spark, sf, "supplier").select(name("S", "s_suppkey").alias("node"), name("N", "s_nationkey").alias("parent"))
    n = table(spark, sf, "nation").select(name("N", "n_nationkey").alias("node"), name("R", "n_regionkey").alias("parent"))
    r = table(spark, sf, "region").select(name("R", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    return linkgraph.ancestor_paths(s.unionByName(n).unionByName(r)).select("node", F.array_join("path", ">").alias("path"), "state")
