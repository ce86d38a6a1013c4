"""Queries over published records: review, availability, serving tables and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators import gates, linkgraph, overlap, records, sampling, tagging
from sievework.plans.curation import _M, _PAIRS, membership
from sievework.plans.graph import _ANCH, _ROUTE, all_anchors, routes
from sievework.plans.mining import _CAND, _SIG, part_signals
from sievework.plans.registry import query
from sievework.plans.scalars import _MATCH
from sievework.session import table


@query("""SELECT p_partkey, p_type FROM part WHERE p_type IN ('PROMO', 'SMALL') ORDER BY p_partkey LIMIT 100 OFFSET 20""")
def f15_scope(spark: SparkSession, sf: str) -> DataFrame:
    return records.scoped(table(spark, sf, "part"), ["PROMO", "SMALL"], "p_type", "p_partkey", 20, 100).select("p_partkey", "p_type")


@query("""WITH p(hub, field, value) AS (VALUES ('PROMO', 'offer', 'promotion'), ('ECONOMY', 'offer', 'value'), ('SMALL', 'scale', 'small'), ('LARGE', 'scale', 'large'), ('Brand#1', 'offer', 'house')), m AS (SELECT p_partkey AS asset, p_type AS hub FROM part UNION ALL SELECT p_partkey, p_brand FROM part), g AS (SELECT asset, field, string_agg(DISTINCT value, ',' ORDER BY value) AS v FROM m JOIN p USING (hub) GROUP BY 1, 2)
SELECT a.p_partkey AS asset, f.field, coalesce(g.v, '') AS "values", CASE WHEN g.v IS NULL THEN 'missing' ELSE 'verified' END AS provenance FROM part a CROSS JOIN (SELECT DISTINCT field FROM p) f LEFT JOIN g ON g.asset = a.p_partkey AND g.field = f.field""")
def f18_attributes(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumnRenamed("p_partkey", "asset")
    policy = spark.createDataFrame([("PROMO", "offer", "promotion"), ("ECONOMY", "offer", "value"), ("SMALL", "scale", "small"), ("LARGE", "scale", "large"), ("Brand#1", "offer", "house")], "hub string, field string, value string")
    m = part.select("asset", F.col("p_type").alias("hub")).unionByName(part.select("asset", F.col("p_brand").alias("hub")))
    return records.attributes(part, m, policy)


@query(f"""WITH {_SIG} SELECT a.term AS "left", b.term AS "right", count(*) AS n FROM g a JOIN g b ON a.asset = b.asset AND a.dim = 'style' AND b.dim = 'subject' GROUP BY 1, 2 HAVING count(*) >= 5""")
def j11_style_subjects(spark: SparkSession, sf: str) -> DataFrame:
    found = part_signals(spark, sf).select("term", F.col("dim").alias("class"), "asset")
    return overlap.combinations(found, "style", "subject", 5)


@query("""WITH o AS (SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS s FROM documents), n AS (SELECT doc_id, CASE WHEN n_chars > 1500 THEN 'long' ELSE 'short' END AS s FROM documents WHERE doc_id % 11 <> 0) SELECT o.doc_id, o.s AS before, n.s AS after FROM o LEFT JOIN n ON o.doc_id = n.doc_id WHERE o.s IS DISTINCT FROM n.s""")
def j18_reclassified(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    status = lambda n: F.when(F.col("n_chars") > n, "long").otherwise("short").alias("status")
    return records.reclassified(d.select("doc_id", status(2000)), d.where("doc_id % 11 <> 0").select("doc_id", status(1500)), "doc_id")


@query("""SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 4 = 0 THEN 'Land ' || n_nationkey END, n_name) AS n_name, CASE WHEN n_nationkey % 4 = 0 THEN 'editorial' ELSE 'own' END AS origin FROM nation""")
def j19_editorial_overlay(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    own = n.where("n_nationkey % 4 = 0").select("n_nationkey", F.concat(F.lit("Land "), F.col("n_nationkey").cast("string")).alias("n_name"))
    return records.overlay(n, own, "n_nationkey", "n_name")


@query("""SELECT d.doc_id, CASE WHEN n_chars > 500 THEN 'included' ELSE 'deferred' END AS state, CASE WHEN n_chars > 500 THEN NULL ELSE coalesce(r.reason, 'unspecified') END AS reason FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, 'labelled' AS reason FROM labels) r ON d.doc_id = r.doc_id""")
def j20_publish_split(spark: SparkSession, sf: str) -> DataFrame:
    reasons = table(spark, sf, "labels").select("doc_id", F.lit("labelled").alias("reason")).distinct()
    return records.publish_split(table(spark, sf, "documents"), "doc_id", F.col("n_chars") > 500, reasons)


@query(f"WITH {_M} SELECT s.hub, s.n AS actual, s.n + (CASE WHEN s.hub LIKE '%3%' THEN 1 ELSE 0 END) AS stored, NOT s.hub LIKE '%3%' AS matches FROM s")
def a03_count_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    m = membership(spark, sf)
    stored = m.groupBy("hub").agg((F.count("*") + F.when(F.first("hub").contains("3"), 1).otherwise(0)).alias("stored"))
    return records.count_snapshots(m, stored)


@query("""SELECT source, count(*) AS requested, count(*) FILTER (n_chars > 300) AS processed, count(*) FILTER (n_chars > 300 AND lang = 'en') AS passed, count(*) FILTER (text LIKE '%!!%') AS quarantined FROM documents GROUP BY source""")
def a05_stage_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return records.stage_counts({"requested": d, "processed": d.where("n_chars > 300"), "passed": d.where("n_chars > 300 and lang = 'en'"), "quarantined": d.where(F.col("text").contains("!!"))}, "source")


@query("""WITH l AS (SELECT p_brand, 'type' AS dim, p_type AS term FROM part UNION ALL SELECT p_brand, 'size', CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_brand, 'const', 'x' FROM part), n AS (SELECT p_brand, dim, term, count(*) AS n FROM l GROUP BY 1, 2, 3 HAVING count(*) >= 3), r AS (SELECT *, count(*) OVER (PARTITION BY p_brand, dim) AS terms, row_number() OVER (PARTITION BY p_brand, dim ORDER BY n DESC, term) AS rank FROM n) SELECT p_brand, dim, term, n, rank FROM r WHERE terms > 1 AND rank <= 12""")
def a13_sections(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_brand", F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.lit("x").alias("const"))
    return records.section_tables(p, ["type", "size", "const"], "p_brand", 12, 3)


@query("""SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1""")
def a18_duplicate_names(spark: SparkSession, sf: str) -> DataFrame:
    return gates.duplicates(table(spark, sf, "part"), {"name": F.lower("p_name")}).select(F.col("value").alias("name"), "n")


@query("""WITH l AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS k FROM lineitem GROUP BY 1) SELECT sha256(k) AS list_hash, count(*) AS n, min(l_orderkey) AS first FROM l GROUP BY 1 HAVING count(*) > 1""")
def a20_identical_lists(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("l"))
    return records.identical_lists(g, "l_orderkey", F.col("l"))


@query(r"""WITH p AS (SELECT list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS p FROM pages), s AS (SELECT DISTINCT '/' || array_to_string(p[1:i-1], '/') AS dir, p[i] AS name, i = len(p) AS is_file FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM p)) SELECT dir, count(*) FILTER (is_file) AS files, count(*) FILTER (NOT is_file) AS dirs FROM s GROUP BY dir""")
def a23_directories(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))
    return records.directory_counts(p, "path")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders")
def a25_positions(spark: SparkSession, sf: str) -> DataFrame:
    return records.positions(table(spark, sf, "orders"), "o_orderkey")


@query("""WITH c AS (SELECT doc_id, unnest(CASE WHEN len(l) > 0 THEN l ELSE ['other'] END) AS code FROM (SELECT doc_id, list_filter([CASE WHEN n_chars > 5000 THEN 'long' END, CASE WHEN lang = 'fr' THEN 'french' END], lambda x: x IS NOT NULL) AS l FROM documents)), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY doc_id) AS rn FROM c) SELECT code, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 4) AS examples FROM r GROUP BY code""")
def a27_review_groups(spark: SparkSession, sf: str) -> DataFrame:
    found = tagging.codes({"long": F.col("n_chars") > 5000, "french": F.col("lang") == "fr"})
    return records.labelled_groups(table(spark, sf, "documents"), "doc_id", found, 4)


#: A digest in SQL over a column ``k`` of a table ``t``: sums of parts of each row's hash, by its first two digits.
_DIGEST = """l AS (SELECT sha256(k) AS l FROM t), b AS (SELECT substr(l, 1, 2) AS b, sum(('0x' || substr(l, 3, 10))::BIGINT) AS s, count(*) AS n FROM l GROUP BY 1),
d AS (SELECT sha256(string_agg(b || ':' || s || ':' || n, chr(10) ORDER BY b || ':' || s || ':' || n)) AS digest, CAST(sum(n) AS BIGINT) AS n FROM b)"""


@query(f"WITH t AS (SELECT p_partkey || chr(1) || p_name || chr(1) || p_brand AS k FROM part), {_DIGEST} SELECT digest, n FROM d")
def a32_protected_digest(spark: SparkSession, sf: str) -> DataFrame:
    return records.protected_digest(table(spark, sf, "part"), "p_partkey", ["p_name", "p_brand"])


@query("""WITH g AS (SELECT source, count(*) FILTER (n_chars > 4000) AS warned FROM documents GROUP BY 1) SELECT source, warned, CAST(greatest(0, least(warned, 60 - coalesce(sum(warned) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS allowed FROM g""")
def w06_warning_budget(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") > 4000).alias("warned"))
    return records.warning_budget(g, [F.asc("source")], "warned", 60)


@query("""WITH a AS (SELECT p_brand, list(p_partkey ORDER BY p_size DESC, p_partkey)[1:3] AS top, list(p_partkey ORDER BY p_partkey)[1:6] AS head FROM part GROUP BY 1), u AS (SELECT p_brand, list_concat(top, head) AS l FROM a) SELECT p_brand, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:7], ',') AS items FROM u""")
def w10_merged_lists(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    top = sampling.top_per_group(p, ["p_brand"], [F.desc("p_size"), F.asc("p_partkey")], 3).groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "p_partkey"))), lambda x: x["p_partkey"]).alias("top"))
    head = sampling.top_per_group(p, ["p_brand"], [F.asc("p_partkey")], 6).groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("head"))
    return top.join(head, "p_brand").select("p_brand", F.array_join(sampling.merged_lists(F.col("top"), F.col("head"), 7), ",").alias("items"))


@query("""SELECT DISTINCT doc_id, finding FROM (SELECT doc_id, 'long' AS finding FROM documents WHERE n_chars > 3000 UNION ALL SELECT doc_id, 'labelled' FROM labels UNION ALL SELECT doc_id, 'long' FROM documents WHERE n_chars > 9000)""")
def o06_unique_findings(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    rows = d.where("n_chars > 3000").select("doc_id", F.lit("long").alias("finding")).unionByName(table(spark, sf, "labels").select("doc_id", F.lit("labelled").alias("finding"))).unionByName(d.where("n_chars > 9000").select("doc_id", F.lit("long").alias("finding")))
    return rows.dropDuplicates()


@query(f"""WITH {_CAND}, h AS (SELECT DISTINCT lower(p_type) AS term FROM part) SELECT c.term, c.n FROM c WHERE c.term NOT IN (SELECT term FROM h) AND c.n >= 8 ORDER BY n DESC, term LIMIT 50""")
def t23_missing_subjects(spark: SparkSession, sf: str) -> DataFrame:
    from sievework.operators import taxonomy

    c = taxonomy.candidates(part_signals(spark, sf), 10).where("n >= 8")
    hubs = table(spark, sf, "part").select(F.lower("p_type").alias("term")).distinct()
    return c.join(hubs, "term", "left_anti").orderBy(F.desc("n"), "term").limit(50).select("term", "n")


@query("""WITH a AS (SELECT p_partkey FROM part WHERE p_size > 10) SELECT 'lineitem' AS name, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM a) UNION ALL SELECT 'part', count(*) FROM a""")
def t22_availability(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    tables = records.available({"part": part, "lineitem": table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "p_partkey")}, part.where("p_size > 10"), "p_partkey")
    counts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in tables.items()]
    return counts[0].unionByName(counts[1])


@query("""WITH r AS (SELECT p_brand AS hub, CASE WHEN p_partkey % 5 = 0 THEN 'old' ELSE 'new' END AS run, [CAST(p_partkey AS VARCHAR), CAST(p_partkey + 1 AS VARCHAR), CAST(p_partkey + 2 AS VARCHAR)] AS related, p_partkey FROM part) SELECT p_partkey, array_to_string(list_filter(related, lambda x: CAST(x AS INT) % 5 <> 0 OR CAST(x AS INT) > m), ',') AS related FROM r, (SELECT max(p_partkey) AS m FROM part) WHERE run <> 'old'""")
def t19_without_former_run(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda k: (F.col("p_partkey") + k).cast("string")
    r = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "old").otherwise("new").alias("run"), F.array(key(0), key(1), key(2)).alias("related"))
    gone = r.where("run = 'old'").select(F.col("p_partkey").cast("string").alias("id"))
    return records.without_run(r, "p_partkey", "old", "related", gone).select("p_partkey", F.array_join("related", ",").alias("related"))


@query(rf"""SELECT p_partkey, p_name AS title, {_MATCH.format("(p_name || ' ' || p_type || ' ' || p_brand)")} AS blob, count(*) OVER (PARTITION BY p_name) AS same_title FROM part""")
def r01_search_index(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.col("p_name").alias("title"), text.match_text(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("blob"), F.count("*").over(Window.partitionBy("p_name")).alias("same_title"))


@query("""SELECT kind, count(*) AS n, count(DISTINCT key) AS keys FROM (SELECT 'item' AS kind, CAST(p_partkey AS VARCHAR) AS key FROM part UNION ALL SELECT 'hub', p_brand FROM part GROUP BY p_brand) GROUP BY kind""")
def r04_navigation_index(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    rows = p.select(F.lit("item").alias("kind"), F.col("p_partkey").cast("string").alias("key")).unionByName(p.select(F.lit("hub").alias("kind"), F.col("p_brand").alias("key")).distinct())
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


@query("""WITH r AS (SELECT p_partkey AS asset, p_partkey + 1 AS other, p_type FROM part) SELECT count(*) AS n, count(*) FILTER (r.p_type = o.p_type) AS shared, count(*) FILTER (o.p_partkey IS NULL) AS invalid FROM r LEFT JOIN part o ON o.p_partkey = r.other""")
def r09_related_quality(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("asset"), "p_type")
    other = p.select(F.col("asset").alias("other"), F.col("p_type").alias("o_type"))
    related = p.withColumn("other", F.col("asset") + 1).join(other, "other", "left")
    return records.related_quality(related, p, F.coalesce(F.col("p_type") == F.col("o_type"), F.lit(False)))


_PAGE_EDGES = rf"""{_ANCH}, e AS (SELECT page AS src, regexp_replace(href, '/+$', '') AS dst FROM a WHERE href LIKE '/%' AND NOT regexp_matches(regexp_replace(href, '/+$', ''), '[.][^/]*$'))"""


@query(f"WITH {_PAGE_EDGES} SELECT src, dst, count(*) AS n, src <> dst AS meaningful, false AS content FROM e GROUP BY src, dst")
def lg07_edges(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.edges_of(all_anchors(spark, sf))


@query(rf"""WITH r AS (SELECT {_ROUTE} AS route, min(page_id) AS id FROM pages GROUP BY 1), l AS (SELECT route FROM r WHERE id % 9 <> 0 UNION SELECT '/unlisted')
SELECT coalesce(r.route, l.route) AS route, CASE WHEN l.route IS NULL THEN 'missing' ELSE 'unexpected' END AS status FROM r FULL JOIN l ON r.route = l.route WHERE r.route IS NULL OR l.route IS NULL""")
def lg16_sitemap_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Routes against a sitemap that leaves out every ninth and names one page too many."""
    r = routes(spark, sf)
    listed = r.where("page_id % 9 <> 0").select("route").unionByName(r.limit(0).select("route")).unionByName(spark.createDataFrame([("/unlisted",)], "route string"))
    return gates.membership_diff(r, listed, "route")


@query(f"WITH {_PAGE_EDGES}, t AS (SELECT DISTINCT src || chr(1) || dst AS k FROM e), {_DIGEST} SELECT (SELECT count(*) FROM a) AS anchors, (SELECT count(DISTINCT page) FROM a) AS pages, (SELECT count(*) FROM t) AS unique_edges, (SELECT count(*) FROM e) AS internal, digest FROM d")
def lg17_graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    a = all_anchors(spark, sf)
    e = linkgraph.edges_of(a)
    totals = a.agg(F.count("*").alias("anchors"), F.count_distinct("page").alias("pages")).join(e.agg(F.count("*").alias("unique_edges"), F.sum("n").alias("internal")))
    return totals.join(records.protected_digest(e, "src", ["dst"]).select("digest"))


@query(r"""WITH s AS (SELECT unnest(regexp_extract_all(html, '(?s)<script type="application/ld\+json">(.*?)</script>', 1)) AS j FROM pages), t AS (SELECT unnest(regexp_extract_all(j, '"@type"\s*:\s*"([^"]+)"', 1)) AS type FROM s) SELECT type, count(*) AS n FROM t GROUP BY type""")
def lg19_structured_types(spark: SparkSession, sf: str) -> DataFrame:
    return linkgraph.structured_types(linkgraph.parse_pages(routes(spark, sf))).groupBy("type").agg(F.count("*").alias("n"))


@query(f"""WITH {_PAIRS} SELECT "left", "right", CASE WHEN a.parent = "right" THEN 'child' WHEN b.parent = "left" THEN 'parent' WHEN a.parent = b.parent THEN 'siblings' ELSE 'other' END AS relation FROM p JOIN (SELECT hub, CASE WHEN hub LIKE 'Brand%' THEN 'SMALL' ELSE 'root' END AS parent FROM s) a ON a.hub = "left" JOIN (SELECT hub, CASE WHEN hub LIKE 'Brand%' THEN 'SMALL' ELSE 'root' END AS parent FROM s) b ON b.hub = "right" """)
def d06_pair_relations(spark: SparkSession, sf: str) -> DataFrame:
    parent = lambda c: F.when(F.col(c).startswith("Brand"), "SMALL").otherwise("root")
    return overlap.pairs(membership(spark, sf)).select("left", "right", overlap.relationship(parent("left"), parent("right")).alias("relation"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT sha256(lower(trim(line))) AS key_hash, count(*) AS n, min(doc_id) AS first FROM l WHERE length(trim(line)) >= 40 GROUP BY 1 HAVING count(*) > 1""")
def d10_repeated_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    from sievework.operators import neardup

    p = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.trim("line")) >= 40)
    return neardup.exact_groups(p, "doc_id", F.lower(F.trim("line")))


@query("""SELECT p_partkey, code FROM (SELECT p_partkey, unnest(list_filter([CASE WHEN count(*) OVER (PARTITION BY p_name) > 40 THEN 'crowded-title' END, CASE WHEN length(p_name) < 9 THEN 'short-title' END, CASE WHEN p_retailprice > 1000 THEN 'dear' END], lambda x: x IS NOT NULL)) AS code FROM part)""")
def q16_title_manifest(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("same", F.count("*").over(Window.partitionBy("p_name")))
    return gates.violations(p, "p_partkey", {"crowded-title": F.col("same") > 40, "short-title": F.length("p_name") < 9, "dear": F.col("p_retailprice") > 1000})


@query("""SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'drop' WHEN s_nationkey = 5 THEN 'merge' ELSE 'keep' END AS decision, CASE WHEN s_acctbal < 0 THEN 'negative balance' WHEN s_nationkey = 5 THEN 'nation policy' END AS reason FROM supplier""")
def q20_decisions(spark: SparkSession, sf: str) -> DataFrame:
    bad, moved = F.col("s_acctbal") < 0, F.col("s_nationkey") == 5
    return table(spark, sf, "supplier").select("s_suppkey", F.when(bad, "drop").when(moved, "merge").otherwise("keep").alias("decision"), F.when(bad, "negative balance").when(moved, "nation policy").alias("reason"))




@query("""WITH r AS (SELECT 'shout' AS concept, doc_id FROM documents WHERE regexp_matches(text, '!!') AND regexp_matches(text, '[A-Z]{6}') UNION ALL SELECT 'licence', doc_id FROM documents WHERE regexp_matches(text, 'Licen[sc]e') UNION ALL SELECT 'mail', doc_id FROM documents WHERE regexp_matches(text, '[a-z]@[a-z]') AND regexp_matches(text, '[0-9]{3}')) SELECT concept, count(*) AS n, min(doc_id) AS first FROM r GROUP BY 1""")
def t17_concept_counts(spark: SparkSession, sf: str) -> DataFrame:
    return records.concept_counts(table(spark, sf, "documents"), "doc_id", "text", {"shout": ("!!", "[A-Z]{6}"), "licence": ("Licen[sc]e", None), "mail": ("[a-z]@[a-z]", "[0-9]{3}")})


@query("""WITH h AS (SELECT 'root' AS hub, CAST(NULL AS VARCHAR) AS parent UNION ALL SELECT DISTINCT p_type, 'root' FROM part UNION ALL SELECT DISTINCT p_brand, 'SMALL' FROM part) SELECT hub, CASE WHEN hub = 'root' THEN '/' WHEN parent = 'root' THEN '/' || lower(hub) ELSE '/' || lower(parent) || '/' || lower(hub) END AS route, CASE WHEN hub = 'root' THEN 0 WHEN parent = 'root' THEN 1 ELSE 2 END AS depth FROM h""")
def t10_route_plan(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    hubs = p.select(F.col("p_type").alias("hub"), F.lit("root").alias("parent")).distinct().unionByName(p.select(F.col("p_brand").alias("hub"), F.lit("SMALL").alias("parent")).distinct())
    return records.route_plan(hubs.unionByName(spark.createDataFrame([("root", None)], "hub string, parent string")), "hub", "parent", "root")


@query("""WITH r AS (SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1 THEN 0 WHEN p_size >= 49 THEN 1 ELSE 2 END AS rank FROM part) SELECT p_partkey, CASE rank WHEN 0 THEN 'hub' WHEN 1 THEN 'flagged' ELSE 'fill' END AS reason FROM r ORDER BY rank, p_partkey LIMIT 100""")
def w22_hub_representatives(spark: SparkSession, sf: str) -> DataFrame:
    return records.one_per_hub(table(spark, sf, "part"), "p_brand", "p_partkey", F.col("p_size") >= 49, 100)


@query("""WITH e AS (SELECT p_type AS hub, CAST(ceil(row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) / 48) AS BIGINT) AS page, p_partkey AS item FROM part), s AS (SELECT p_type AS hub, CAST(ceil(row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) / 48) AS BIGINT) AS page, p_partkey AS item FROM part WHERE p_partkey % 100 <> 7),
x AS (SELECT hub, page, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS l FROM e GROUP BY 1, 2), y AS (SELECT hub, page, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS l FROM s GROUP BY 1, 2)
SELECT coalesce(x.hub, y.hub) AS hub, coalesce(x.page, y.page) AS page, CASE WHEN x.l IS NULL THEN 'extra-page' WHEN y.l IS NULL THEN 'missing-page' ELSE 'members-differ' END AS finding FROM x FULL JOIN y ON x.hub = y.hub AND x.page = y.page WHERE x.l IS DISTINCT FROM y.l""")
def lg13_pagination(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_type").alias("hub"), F.col("p_partkey").alias("item"))
    paged = lambda d: d.withColumn("page", sampling.page_of(Window.partitionBy("hub").orderBy("item"), 48))
    return records.pagination_findings(paged(p.where("item % 100 <> 7")), paged(p))


@query("""WITH r AS (SELECT url AS page, CASE WHEN page_id % 6 = 0 THEN NULL ELSE CASE WHEN page_id % 10 = 1 THEN 'http' ELSE 'https' END || '://img.example/' || (page_id // 2) END AS image FROM pages), s AS (SELECT *, CASE WHEN image IS NOT NULL THEN count(*) OVER (PARTITION BY image) ELSE 0 END AS k FROM r), g AS (SELECT page, count(image) AS n, max(k) AS k, bool_or(NOT regexp_matches(image, '^https://')) AS bad FROM s GROUP BY page)
SELECT page, unnest(list_filter([CASE WHEN n = 0 THEN 'no-image' END, CASE WHEN n > 1 THEN 'many-images' END, CASE WHEN k > 1 THEN 'shared-image' END, CASE WHEN bad THEN 'not-https' END], lambda x: x IS NOT NULL)) AS finding FROM g""")
def q23_image_map(spark: SparkSession, sf: str) -> DataFrame:
    image = F.concat(F.when(F.col("page_id") % 10 == 1, "http").otherwise("https"), F.lit("://img.example/"), F.floor(F.col("page_id") / 2).cast("string"))
    rows = table(spark, sf, "pages").select(F.col("url").alias("page"), F.when(F.col("page_id") % 6 != 0, image).alias("image"))
    return records.image_map_findings(rows, 1)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag || l_linestatus AS variant, CASE WHEN l_quantity < 5 THEN 'thin' ELSE 'taxed' END AS first_flag FROM lineitem WHERE l_returnflag = 'A' AND (l_quantity < 5 OR l_tax > 0.07)""")
def a08_flagged_rows(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").where("l_returnflag = 'A'")
    flags = tagging.codes({"thin": F.col("l_quantity") < 5, "taxed": F.col("l_tax") > 0.07})
    return li.withColumn("f", flags).where(F.size("f") > 0).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("variant"), F.get("f", F.lit(0)).alias("first_flag"))


@query("""SELECT p_partkey, p_name AS title, s.n AS orders FROM part JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) s ON l_partkey = p_partkey""")
def f17_public_projection(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("orders"))
    return table(spark, sf, "part").join(n, "p_partkey").select("p_partkey", F.col("p_name").alias("title"), "orders")
