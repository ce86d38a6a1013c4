"""Queries over audits, title rules, candidate decisions and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators import audits, gates, records, sampling
from sievework.plans.registry import query
from sievework.plans.scalars import _MATCH, _WORDS
from sievework.session import table


def part(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part")


def _s(c: str) -> F.Column:
    return F.col(c).cast("string")


_BRANDS = "h AS (SELECT p_brand AS hub, count(*) AS n, count(DISTINCT p_type) AS types, max(p_size) AS big, min(p_partkey) AS low FROM part GROUP BY 1)"


@query(f"""WITH {_BRANDS}, p AS (SELECT *, list_filter([CASE WHEN types < 6 THEN 'missing route' END, CASE WHEN n % 5 = 0 THEN 'count mismatch' END, CASE WHEN low % 3 = 0 THEN 'missing content' END, CASE WHEN n % 7 = 0 THEN 'below minimum' END], lambda x: x IS NOT NULL) AS l FROM h)
SELECT hub, CASE WHEN list_contains(l, 'below minimum') THEN 'should-demote' WHEN list_contains(l, 'count mismatch') THEN 'needs-count-fix' WHEN list_contains(l, 'missing route') THEN 'needs-route-fix' WHEN list_contains(l, 'missing content') THEN 'needs-copy-fix' WHEN low % 2 = 1 THEN 'owner-review-needed' ELSE 'accepted' END AS status, array_to_string(list_sort(l), ',') AS problems FROM p""")
def q10_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    h = part(spark, sf).groupBy(F.col("p_brand").alias("hub")).agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("types"), F.min("p_partkey").alias("low"))
    problems = audits.codes({"missing route": F.col("types") < 6, "count mismatch": F.col("n") % 5 == 0, "missing content": F.col("low") % 3 == 0, "below minimum": F.col("n") % 7 == 0})
    ladder = [("needs-copy-fix", ["missing content"]), ("needs-route-fix", ["missing route"]), ("needs-count-fix", ["count mismatch"]), ("should-demote", ["below minimum"])]
    return audits.acceptance(h, "hub", problems, ladder, F.col("low") % 2 == 1)


_DOC_TITLE = "split_part(coalesce(text, ''), chr(10), 1)"
_SEO = f"""p AS (SELECT doc_id, left({_DOC_TITLE}, 80) AS title, substr(text, 81, 120) AS description, left(lower(coalesce(text, '')), 30) AS start FROM documents),
w AS (SELECT *, count(*) OVER (PARTITION BY title) AS t, count(*) OVER (PARTITION BY description) AS d, count(*) OVER (PARTITION BY start) AS s FROM p),
c AS (SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(coalesce(title, '')) = '' THEN 'no-title' END, CASE WHEN trim(coalesce(title, '')) <> '' AND t > 1 THEN 'repeated-title' END, CASE WHEN trim(coalesce(description, '')) = '' THEN 'no-description' END, CASE WHEN trim(coalesce(description, '')) <> '' AND d > 1 THEN 'repeated-description' END, CASE WHEN s > 3 THEN 'boilerplate' END], lambda x: x IS NOT NULL), ',') AS codes FROM w)"""


def seo(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "documents").select("doc_id", F.left(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)), F.lit(80)).alias("title"), F.substring("text", 81, 120).alias("description"), "text")
    return audits.seo_entries(p, "doc_id", "title", "description", "text", 30, 3)


@query(f"WITH {_SEO} SELECT * FROM c")
def q11_seo_entries(spark: SparkSession, sf: str) -> DataFrame:
    return seo(spark, sf)


@query(f"WITH {_SEO} SELECT count(*) AS pages, count(*) FILTER (codes <> '') AS failed, count(*) FILTER (codes <> '') = 0 AS passed FROM c")
def q11_seo_summary(spark: SparkSession, sf: str) -> DataFrame:
    return audits.seo_summary(seo(spark, sf))


@query("""WITH h AS (SELECT p_brand AS page, CASE WHEN count(*) % 9 = 0 THEN 'gone' ELSE min(p_type) END AS parent FROM part GROUP BY 1 UNION SELECT DISTINCT p_type, NULL FROM part), k AS (SELECT DISTINCT p_brand AS page, CASE WHEN p_size = 50 THEN p_name ELSE p_type END AS target FROM part)
SELECT page, 'broken' AS finding, target FROM k WHERE target NOT IN (SELECT page FROM h) UNION ALL SELECT page, 'held-back', target FROM k WHERE target = 'PROMO' UNION ALL SELECT page, 'no-links', NULL FROM h WHERE page NOT IN (SELECT page FROM k) UNION ALL SELECT page, 'no-parent', parent FROM h WHERE parent IS NOT NULL AND parent NOT IN (SELECT page FROM h)""")
def q12_link_data(spark: SparkSession, sf: str) -> DataFrame:
    p = part(spark, sf)
    types = p.select(F.col("p_type").alias("page")).distinct().withColumn("parent", F.lit(None).cast("string"))
    hubs = p.groupBy(F.col("p_brand").alias("page")).agg(F.when(F.count("*") % 9 == 0, "gone").otherwise(F.min("p_type")).alias("parent")).unionByName(types)
    links = p.select(F.col("p_brand").alias("page"), F.when(F.col("p_size") == 50, F.col("p_name")).otherwise(F.col("p_type")).alias("target")).distinct()
    return audits.link_data_findings(links, hubs.select("page"), types.where("page = 'PROMO'").select("page"), hubs)


@query("""WITH r AS (SELECT p_partkey AS route, p_size > 5 AS indexable FROM part), l AS (SELECT p_partkey AS route FROM part WHERE p_partkey % 10 <> 3 UNION ALL SELECT p_partkey FROM part WHERE p_partkey % 50 = 7 UNION ALL SELECT -1 - p_partkey FROM part WHERE p_partkey % 500 = 0), n AS (SELECT route, count(*) AS n FROM l GROUP BY 1),
f AS (SELECT coalesce(r.route, n.route) AS route, list_filter([CASE WHEN indexable IS NULL THEN 'unknown' END, CASE WHEN coalesce(indexable, false) AND n IS NULL THEN 'missing' END, CASE WHEN NOT coalesce(indexable, true) AND n IS NOT NULL THEN 'not-indexable' END, CASE WHEN coalesce(n, 0) > 1 THEN 'twice' END], lambda x: x IS NOT NULL) AS l FROM r FULL JOIN n ON r.route = n.route) SELECT route, unnest(l) AS finding FROM f""")
def q13_routes(spark: SparkSession, sf: str) -> DataFrame:
    p = part(spark, sf)
    k = F.col("p_partkey")
    listed = p.where(k % 10 != 3).select(k.alias("route")).unionByName(p.where(k % 50 == 7).select(k.alias("route"))).unionByName(p.where(k % 500 == 0).select((-1 - k).alias("route")))
    return audits.route_findings(p.select(k.alias("route"), (F.col("p_size") > 5).alias("indexable")), listed)


_TITLE = "CASE WHEN p_partkey % 11 = 0 THEN p_name || '_' || p_partkey || '.png' WHEN p_partkey % 13 = 0 THEN p_name || ' final Pages' WHEN p_partkey % 17 = 0 THEN upper(p_name) || ' Pages' WHEN p_partkey % 19 = 0 THEN p_name || ' ' || p_name || '  (Pages' ELSE p_brand || ' ' || p_name || ' ' || p_partkey || ' Pages' END"


def titles(spark: SparkSession, sf: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    t = F.when(k % 11 == 0, F.concat(name, F.lit("_"), _s("p_partkey"), F.lit(".png"))).when(k % 13 == 0, F.concat(name, F.lit(" final Pages"))).when(k % 17 == 0, F.concat(F.upper(name), F.lit(" Pages")))
    t = t.when(k % 19 == 0, F.concat(name, F.lit(" "), name, F.lit("  (Pages"))).otherwise(F.concat(F.col("p_brand"), F.lit(" "), name, F.lit(" "), _s("p_partkey"), F.lit(" Pages")))
    return part(spark, sf).select("p_partkey", t.alias("title"), "p_brand", "p_type", "p_size", "p_name")


@query(rf"""WITH t AS (SELECT p_partkey, {_TITLE} AS title FROM part), c AS (SELECT *, count(*) OVER (PARTITION BY lower(title)) AS n FROM t), f AS (SELECT p_partkey, title, array_to_string(list_filter([CASE WHEN NOT regexp_matches(title, 'Pages$') THEN 'no-suffix' END, CASE WHEN n > 1 THEN 'duplicate' END, CASE WHEN regexp_matches(title, '(?i)\.(png|jpe?g|svg|pdf)\b') THEN 'extension' END, CASE WHEN regexp_matches(title, '\bfinal\b') THEN 'internal-wording' END], lambda x: x IS NOT NULL), ',') AS codes FROM c) SELECT * FROM f WHERE codes <> ''""")
def q18_title_review(spark: SparkSession, sf: str) -> DataFrame:
    return audits.title_review(titles(spark, sf), "p_partkey", "title", "Pages$", r"\bfinal\b")


#: RE2 has no back references, so SQL compares neighbouring words instead of ``repeated-word``'s pattern.
_FLAGS = ", ".join(
    f"CASE WHEN len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] AND w[i] <> '')) > 0 THEN '{n}' END" if n == "repeated-word" else f"CASE WHEN regexp_matches(title, '{p}') THEN '{n}' END"
    for n, p in audits.TITLE_RULES
)


@query(rf"""WITH t AS (SELECT p_partkey, {_TITLE} AS title FROM part), x AS (SELECT *, regexp_split_to_array(lower(title), '\W+') AS w FROM t) SELECT p_partkey, array_to_string(list_filter([{_FLAGS}], lambda x: x IS NOT NULL), ',') AS flags FROM x""")
def f08_title_flags(spark: SparkSession, sf: str) -> DataFrame:
    return titles(spark, sf).select("p_partkey", F.array_join(audits.title_flags(F.col("title")), ",").alias("flags"))


@query(rf"""WITH t AS (SELECT p_partkey, {_TITLE} AS title FROM part), i AS (SELECT p_partkey, list_filter([CASE WHEN contains(title, '.png') THEN 'extension' END, CASE WHEN contains(title, '_') THEN 'underscore' END, CASE WHEN contains(title, '  ') THEN 'spaces' END, CASE WHEN contains(title, 'final') THEN 'wording' END], lambda x: x IS NOT NULL) AS l FROM t)
SELECT p_partkey, CASE WHEN list_contains(l, 'wording') OR len(l) > 2 THEN 'low' WHEN len(l) > 0 THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN list_contains(l, 'wording') OR len(l) > 2 THEN 'manual' WHEN len(l) > 0 THEN 'rename' ELSE 'keep' END AS action FROM i""")
def f06_issue_actions(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("title")
    issues = audits.codes({"extension": F.contains(t, F.lit(".png")), "underscore": F.contains(t, F.lit("_")), "spaces": F.contains(t, F.lit("  ")), "wording": F.contains(t, F.lit("final"))})
    sure, action = audits.issue_action(issues, ["wording"], ["spaces"])
    return titles(spark, sf).select("p_partkey", sure.alias("confidence"), action.alias("action"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents), n AS (SELECT * FROM l, (VALUES ('the'), ('.')) v(needle)), s AS (SELECT *, string_split(lower(line), needle) AS p FROM n),
h AS (SELECT doc_id, needle, line_no, line, unnest(list_transform(range(1, len(p)), lambda k: 1 + list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(needle))) AS col FROM s WHERE len(p) > 1)
SELECT doc_id, needle, line_no, CAST(col AS BIGINT) AS col, substr(line, CAST(greatest(1, col - 8) AS BIGINT), 24) AS context FROM h""")
def f12_all_hits(spark: SparkSession, sf: str) -> DataFrame:
    return audits.all_hits(table(spark, sf, "documents"), "doc_id", "text", ["the", "."], 8, 24).withColumns({"line_no": F.col("line_no").cast("bigint"), "col": F.col("col").cast("bigint")})


@query("""WITH s AS (SELECT p_partkey, p_size FROM part), x AS (SELECT 'sitemap' AS system, p_partkey, 'missing' AS status FROM s WHERE p_partkey % 9 = 0 UNION ALL SELECT 'sitemap', -1 - p_partkey, 'unexpected' FROM s WHERE p_partkey % 400 = 0 UNION ALL SELECT 'images', p_partkey, 'missing' FROM s WHERE p_size >= 49 UNION ALL SELECT 'navigation', p_partkey, 'unexpected' FROM s WHERE p_size = 1) SELECT system, p_partkey, status FROM x""")
def q21_sync(spark: SparkSession, sf: str) -> DataFrame:
    p, k = part(spark, sf).select("p_partkey", "p_size"), F.col("p_partkey")
    mapped = p.where(k % 9 != 0).select(k).unionByName(p.where(k % 400 == 0).select((-1 - k).alias("p_partkey")))
    return audits.sync_findings({"sitemap": (p, mapped), "images": (p, p.where("p_size < 49")), "navigation": (p.where("p_size > 1"), p)}, "p_partkey")


_FILE = "lower(p_type) || '/' || CASE WHEN p_partkey % 21 = 0 THEN 'bad name ' ELSE '' END || p_partkey || CASE WHEN p_partkey % 27 = 0 THEN '.exe' ELSE '.png' END"


@query(rf"""WITH e AS (SELECT {_FILE} AS file, p_partkey AS k FROM part), g AS (SELECT file FROM e WHERE k % 33 <> 0 UNION ALL SELECT file FROM e WHERE k % 35 = 1 AND k % 33 <> 0 UNION ALL SELECT 'extra/' || k || '.png' FROM e WHERE k % 300 = 0), n AS (SELECT file, count(*) AS n FROM g GROUP BY 1)
SELECT file, 'missing' AS finding FROM e WHERE k % 33 = 0 UNION ALL SELECT file, 'unexpected' FROM n WHERE file LIKE 'extra/%' UNION ALL SELECT file, 'twice' FROM n WHERE n > 1 UNION ALL SELECT file, 'forbidden-kind' FROM n WHERE file LIKE '%.exe' UNION ALL SELECT file, 'bad-key' FROM n WHERE NOT regexp_matches(file, '^[a-z]+/[0-9]+\.[a-z]+$')""")
def q22_bundle(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    file = F.concat(F.lower("p_type"), F.lit("/"), F.when(k % 21 == 0, "bad name ").otherwise(""), k.cast("string"), F.when(k % 27 == 0, ".exe").otherwise(".png"))
    e = part(spark, sf).select(file.alias("file"), k.alias("k"))
    extra = e.where("k % 300 = 0").select(F.concat(F.lit("extra/"), _s("k"), F.lit(".png")).alias("file"))
    found = e.where("k % 33 <> 0").select("file").unionByName(e.where("k % 35 = 1 and k % 33 <> 0").select("file")).unionByName(extra)
    return audits.bundle_findings(e, found, ["png"], r"^[a-z]+/[0-9]+\.[a-z]+$")


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_totalprice < 2000 THEN 'blank' WHEN o_orderstatus = 'P' THEN 'category-block' ELSE 'approved' END AS before, CASE WHEN o_totalprice < 1500 THEN 'blank' WHEN o_totalprice > 400000 THEN 'overfilled' ELSE 'approved' END AS after FROM orders) SELECT o_orderkey, before, after FROM c WHERE before <> after""")
def q06_reclassified(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    old = {"blank": price < 2000, "category-block": F.col("o_orderstatus") == "P"}
    return audits.reclassified_by(table(spark, sf, "orders"), "o_orderkey", old, {"blank": price < 1500, "overfilled": price > 400000})


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_extendedprice <= 0 THEN 'empty-output' END, CASE WHEN l_discount > 0.09 THEN 'too-dark' END, CASE WHEN l_tax > 0.07 AND l_quantity < 5 THEN 'too-complex' END], lambda x: x IS NOT NULL)) AS code FROM lineitem) SELECT code, count(*) AS n FROM c GROUP BY 1""")
def q09_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"empty-output": F.col("l_extendedprice") <= 0, "too-dark": F.col("l_discount") > 0.09, "too-complex": (F.col("l_tax") > 0.07) & (F.col("l_quantity") < 5)}
    return gates.violations(table(spark, sf, "lineitem"), "l_orderkey", rules).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT p_type, count(*) AS n FROM part WHERE p_type IN (SELECT p_type FROM part GROUP BY 1 HAVING count(*) FILTER (p_size > 45) <= (SELECT count(*) FROM part) / 60) GROUP BY 1")
def q04_guarded(spark: SparkSession, sf: str) -> DataFrame:
    """A type's rows come out only if few enough of them are rejected."""
    p = part(spark, sf)
    total = p.count()
    kept = gates.guarded_by(p, "p_type", F.col("p_size") > 45, total / 60)
    return kept.groupBy("p_type").agg(F.count("*").alias("n"))


_W = _WORDS.format(_MATCH.format("{}"))


@query(f"""WITH h AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, split_part(text, chr(10), 2) AS intro FROM documents WHERE text IS NOT NULL), i AS (SELECT doc_id, unnest({_W.format('intro')}) AS w FROM h), m AS (SELECT doc_id, unnest({_W.format('title')}) AS w FROM h UNION SELECT doc_id, unnest(['la', 'of']) FROM h WHERE doc_id % 2 = 0), y AS (SELECT DISTINCT doc_id FROM i JOIN m USING (doc_id, w))
SELECT h.doc_id, y.doc_id IS NOT NULL AS supported FROM h LEFT JOIN y ON h.doc_id = y.doc_id""")
def d08_inventory_evidence(spark: SparkSession, sf: str) -> DataFrame:
    line = lambda i: F.split_part("text", F.lit("\n"), F.lit(i))
    h = table(spark, sf, "documents").where("text is not null").select("doc_id", line(1).alias("title"), line(2).alias("intro"))
    return audits.inventory_evidence(h, h.where("doc_id % 2 = 0").select("doc_id", F.lit("la of").alias("title")), "doc_id")


@query(r"""WITH c AS (SELECT doc_id, CASE WHEN n_chars > 3000 THEN 'core' ELSE 'thin' END AS tier, text FROM documents WHERE doc_id % 6 <> 5), m AS (SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN 'core' ELSE 'thin' END AS want, c.tier, c.text FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id), w AS (SELECT *, count(*) OVER (PARTITION BY lower(trim(text))) AS n FROM m)
SELECT count(*) AS hubs, count(*) FILTER (text IS NULL) AS missing, count(*) FILTER (want <> tier) AS tier_mismatch, count(*) FILTER (text IS NOT NULL AND n > 1) AS duplicate, count(*) FILTER (regexp_matches(text, 'reserved')) AS forbidden, count(*) FILTER (length(text) < 300) AS weak, count(*) FILTER (regexp_matches(text, '\b[0-9]+\s+[a-z]+')) AS embedded_counts FROM w""")
def d09_content_summary(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    hubs = d.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "core").otherwise("thin").alias("tier"))
    content = d.where("doc_id % 6 <> 5").select("doc_id", F.when(F.col("n_chars") > 3000, "core").otherwise("thin").alias("tier"), "text")
    return audits.content_summary(hubs, content, "doc_id", "tier", "text", "reserved", 300)


@query("SELECT lower(p_type) || '/' || replace(p_name, ' ', '-') AS path, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1 HAVING count(*) > 1")
def a28_path_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return audits.collisions(part(spark, sf), F.concat(F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-"))), "p_partkey")


@query("""WITH r AS (SELECT p_brand, p_type, p_partkey, p_size > 45 AS w, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY sha256(CAST(p_partkey AS VARCHAR)), p_partkey) AS rn FROM part)
SELECT p_brand, p_type, count(*) AS n, count(*) FILTER (w) AS warned, coalesce(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) FILTER (rn <= 12), '') AS sample FROM r GROUP BY 1, 2""")
def a29_gallery_export(spark: SparkSession, sf: str) -> DataFrame:
    return audits.gallery_export(part(spark, sf), "p_brand", "p_type", "p_partkey", F.col("p_size") > 45, 12)


@query("""WITH s AS (SELECT p_brand, p_partkey, CASE WHEN p_type = 'PROMO' THEN 40 ELSE 0 END + CASE WHEN p_size > 20 THEN 25 ELSE 0 END + CASE WHEN contains(p_name, 'red') THEN 10 ELSE 0 END AS score FROM part) SELECT p_brand, p_partkey, score, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS pos FROM s""")
def w14_member_order(spark: SparkSession, sf: str) -> DataFrame:
    return audits.member_order(part(spark, sf), "p_brand", "p_partkey", [(F.col("p_type") == "PROMO", 40), (F.col("p_size") > 20, 25), (F.contains("p_name", F.lit("red")), 10)])


@query("""WITH r AS (SELECT p_partkey, p_brand, p_size, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part), a AS (SELECT p_partkey FROM r WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND turn = 1),
b AS (SELECT p_partkey FROM r WHERE p_size >= 49 AND p_partkey NOT IN (SELECT p_partkey FROM a) ORDER BY p_partkey LIMIT 5), c AS (SELECT p_partkey FROM r WHERE p_type = 'PROMO' AND p_partkey NOT IN (SELECT p_partkey FROM a UNION SELECT p_partkey FROM b) ORDER BY p_partkey LIMIT 4),
p AS (SELECT p_partkey, 'priority' AS reason, 0 AS step, NULL AS hub FROM a UNION ALL SELECT p_partkey, 'big', 1, NULL FROM b UNION ALL SELECT p_partkey, 'promo', 2, NULL FROM c)
SELECT p_partkey, reason FROM (SELECT * FROM p UNION ALL SELECT p_partkey, 'fill', turn + 2, p_brand FROM r WHERE p_partkey NOT IN (SELECT p_partkey FROM p)) ORDER BY step, hub NULLS FIRST, p_partkey LIMIT 40""")
def w21_covering_picks(spark: SparkSession, sf: str) -> DataFrame:
    quotas = [("big", F.col("p_size") >= 49, 5), ("promo", F.col("p_type") == "PROMO", 4)]
    return audits.covering_picks(part(spark, sf), "p_brand", "p_partkey", ["Brand#1", "Brand#2", "Brand#3"], quotas, 40)


PHRASES = [("ring", "small ring"), ("bolt", "bolt"), ("gear", "old gear"), ("widget", "widget"), ("promo", "promo")]
_PHR = "v(term, phrase) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PHRASES) + ")"
_HITS = f"""{_PHR}, t AS (SELECT p_partkey AS asset, ' ' || lower(p_name || CASE WHEN p_partkey % 3 = 0 THEN 's ' ELSE ' ' END || p_type) || ' ' AS t FROM part), x AS (SELECT DISTINCT term, asset FROM t, v WHERE contains(t, ' ' || phrase || ' ') OR contains(t, ' ' || phrase || 's '))"""


def hits(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, "s ").otherwise(" "), F.col("p_type"))
    return audits.term_hits(part(spark, sf).withColumn("label", label), spark.createDataFrame(PHRASES, "term string, phrase string"), "p_partkey", "label")


@query(f"WITH {_HITS} SELECT term, asset FROM x")
def j12_term_hits(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf)


@query(f"""WITH {_HITS}, n AS (SELECT term, count(*) AS n FROM x GROUP BY 1), m AS (SELECT term, p_type AS hub, count(*) AS common FROM x JOIN part ON asset = p_partkey GROUP BY 1, 2), b AS (SELECT term, max_by(hub, (common, hub)) AS closest, max(common) AS common FROM m GROUP BY 1)
SELECT term, n, closest, round(coalesce(common / n, 0), 6) AS overlap, CASE WHEN n < 10 THEN 'backlog' WHEN round(common / n, 6) >= 0.9 THEN 'redundant' WHEN round(common / n, 6) >= 0.6 THEN 'review' ELSE 'promote' END AS state FROM n LEFT JOIN b USING (term)""")
def t11_long_tail(spark: SparkSession, sf: str) -> DataFrame:
    return audits.long_tail(hits(spark, sf), part(spark, sf).select(F.col("p_type").alias("hub"), F.col("p_partkey").alias("asset")), 10)


RULES = [("title", "head", r"^([^\s.,]+ [^\s.,]+)"), ("text", "the", r"\bthe ([a-z]+)"), ("text", "de", r"\bde ([a-z]+)")]
_EXT = "e AS (" + " UNION ALL ".join(f"SELECT doc_id, lower(trim(unnest(regexp_extract_all(text, '{p}', 1)))) AS phrase, '{s}' AS source, '{c}' AS context FROM documents" for s, c, p in RULES) + ")"


def phrases(spark: SparkSession, sf: str) -> DataFrame:
    return audits.extracted(table(spark, sf, "documents"), "doc_id", "text", RULES)


@query(f"WITH {_EXT} SELECT source, context, count(*) AS n, count(DISTINCT phrase) AS phrases, count(DISTINCT doc_id) AS docs FROM e GROUP BY 1, 2")
def t14_extracted(spark: SparkSession, sf: str) -> DataFrame:
    return phrases(spark, sf).groupBy("source", "context").agg(F.count("*").alias("n"), F.count_distinct("phrase").alias("phrases"), F.count_distinct("doc_id").alias("docs"))


_ROLL = f"""{_EXT}, r AS (SELECT DISTINCT e.doc_id, phrase, e.source, context, d.source AS category FROM e JOIN documents d ON e.doc_id = d.doc_id), b AS (SELECT phrase, context, count(DISTINCT doc_id) AS c FROM r GROUP BY 1, 2), k AS (SELECT phrase, min_by(context, (-c, context)) AS context, count(*) AS contexts FROM b GROUP BY 1),
u AS (SELECT phrase, count(DISTINCT doc_id) AS assets, count(DISTINCT category) AS categories, count(DISTINCT source) AS sources FROM r GROUP BY 1), roll AS (SELECT u.*, context, contexts FROM u JOIN k USING (phrase))"""


def rolled(spark: SparkSession, sf: str) -> DataFrame:
    return audits.rolled_up(phrases(spark, sf), "doc_id", table(spark, sf, "documents").select("doc_id", F.col("source").alias("category")))


@query(f"WITH {_ROLL} SELECT * FROM roll")
def t15_rolled_up(spark: SparkSession, sf: str) -> DataFrame:
    return rolled(spark, sf)


_ORD = "array_to_string(list_sort(string_split(lower({}), ' ')), ' ')"
_DECIDED = f"""{_ROLL}, known AS (SELECT DISTINCT {_ORD.format("p_name")} AS o FROM part UNION SELECT 'and'), dec AS (SELECT phrase, assets, CASE WHEN regexp_matches(phrase, 'th.?th') THEN 'rejected' WHEN {_ORD.format('phrase')} IN (SELECT o FROM known) THEN 'rejected' WHEN phrase IN ('of', 'la') THEN 'rejected' WHEN context = 'head' AND assets >= 8 THEN 'manual_review' WHEN context = 'head' THEN 'backlog' WHEN assets >= 8 AND categories >= 4 THEN 'promote_candidate' WHEN assets >= 8 THEN 'manual_review' WHEN assets >= 6 THEN 'manual_review' ELSE 'backlog' END AS decision,
CASE WHEN regexp_matches(phrase, 'th.?th') THEN 'risk' WHEN {_ORD.format('phrase')} IN (SELECT o FROM known) THEN 'duplicate' WHEN phrase IN ('of', 'la') THEN 'generic' WHEN context = 'head' THEN 'untrusted' WHEN assets >= 8 AND categories >= 4 THEN 'meets-threshold' WHEN assets >= 8 THEN 'ambiguous' WHEN assets >= 6 THEN 'below-threshold' ELSE 'too-little' END AS reason FROM roll)"""


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    existing = part(spark, sf).select(F.col("p_name").alias("title")).distinct().unionByName(spark.createDataFrame([("and",)], "title string"))
    return audits.decided(rolled(spark, sf), existing, "th.?th", ["of", "la"], F.col("context") != "head", F.lit(8), F.col("categories") >= 4)


@query(f"WITH {_DECIDED} SELECT * FROM dec")
def t16_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return decisions(spark, sf)


@query(f"WITH {_DECIDED} SELECT count(*) AS candidates, count(*) FILTER (regexp_matches(phrase, 'th.?th')) AS risky, count(*) FILTER (regexp_matches(phrase, 'th.?th') AND decision = 'promote_candidate') AS promoted, count(*) FILTER (regexp_matches(phrase, 'th.?th') AND decision = 'promote_candidate') = 0 AS passed FROM dec")
def t18_risk_audit(spark: SparkSession, sf: str) -> DataFrame:
    return audits.risk_audit(decisions(spark, sf), "th.?th")


@query("""WITH c AS (SELECT p_brand || ':' || p_name AS hub, count(*) AS n, count(DISTINCT p_type) AS categories, count(DISTINCT p_size) AS subjects, contains(p_name, 'ring') AS specific, count(*) FILTER (p_type = 'PROMO') / count(*) AS overlap, min(p_partkey) % 5 = 0 AS duplicate FROM part GROUP BY p_brand, p_name),
s AS (SELECT *, CASE WHEN n >= 400 THEN 20 WHEN n >= 150 THEN 17 WHEN n >= 60 THEN 13 WHEN n >= 20 THEN 8 ELSE 2 END AS depth, CASE WHEN specific THEN 16 ELSE 10 END + CASE WHEN categories > 3 THEN 2 ELSE 0 END AS clarity, CAST(least(20, subjects * 2 + categories * 2 + CASE WHEN specific THEN 4 ELSE 0 END) AS INT) AS "unique", CAST(least(20, round(overlap * 20)) AS INT) AS overlap_risk, CASE WHEN duplicate THEN 20 ELSE 0 END AS duplicate_risk FROM c),
v AS (SELECT *, CAST(least(20, round((depth + clarity) / 2 + least(4, categories))) AS INT) AS value FROM s)
SELECT hub, depth, clarity, "unique", overlap_risk, duplicate_risk, value, CAST(greatest(0, least(100, round(clarity * 1.5::DOUBLE + depth * 1.35::DOUBLE + "unique" * 0.85::DOUBLE + value * 1.4::DOUBLE - overlap_risk * 0.7::DOUBLE - duplicate_risk * 1.1::DOUBLE))) AS INT) AS final FROM v""")
def t05_sub_scores(spark: SparkSession, sf: str) -> DataFrame:
    c = part(spark, sf).groupBy("p_brand", "p_name").agg(
        F.count("*").alias("n"), F.count_distinct("p_type").alias("categories"), F.count_distinct("p_size").alias("subjects"), (F.count_if(F.col("p_type") == "PROMO") / F.count("*")).alias("overlap"), (F.min("p_partkey") % 5 == 0).alias("duplicate"),
    )
    c = c.select(F.concat_ws(":", "p_brand", "p_name").alias("hub"), "n", "categories", "subjects", "overlap", "duplicate", F.contains("p_name", F.lit("ring")).alias("specific"))
    return audits.sub_scores(c).select("hub", "depth", "clarity", "unique", "overlap_risk", "duplicate_risk", "value", "final")


_POLICY = """m0 AS (SELECT p_brand AS hub, p_partkey AS asset FROM part UNION SELECT p_type, p_partkey FROM part), mv AS (SELECT p_partkey AS asset, p_type AS hub, false AS a FROM part WHERE p_type = 'SMALL' UNION ALL SELECT p_partkey, 'Brand#1', true FROM part WHERE p_size = 50),
m1 AS (SELECT hub, asset FROM m0 WHERE (hub, asset) NOT IN (SELECT (hub, asset) FROM mv WHERE NOT a) UNION SELECT hub, asset FROM mv WHERE a), n AS (SELECT hub, count(*) AS n FROM m1 GROUP BY 1),
h0 AS (SELECT p_brand AS hub, min(p_type) AS parent FROM part GROUP BY 1 UNION SELECT DISTINCT p_type, NULL FROM part),
h1 AS (SELECT h0.hub, CASE WHEN h0.hub IN ('Brand#1', 'Brand#2') THEN 'PROMO' ELSE parent END AS parent, h0.hub <> 'Brand#3' AND coalesce(n, 0) > 0 AS indexable, coalesce(n, 0) AS n FROM h0 LEFT JOIN n ON h0.hub = n.hub)"""


def policy(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p, nothing = part(spark, sf), F.lit(None).cast("string")
    m = p.select(F.col("p_brand").alias("hub"), F.col("p_partkey").alias("asset")).unionByName(p.select(F.col("p_type").alias("hub"), F.col("p_partkey").alias("asset")))
    hubs = p.groupBy(F.col("p_brand").alias("hub")).agg(F.min("p_type").alias("parent")).unionByName(p.select(F.col("p_type").alias("hub"), nothing.alias("parent")).distinct()).withColumn("indexable", F.lit(True))
    moves = p.where("p_type = 'SMALL'").select(F.col("p_partkey").alias("asset"), F.col("p_type").alias("hub"), F.lit(False).alias("add")).unionByName(p.where("p_size = 50").select(F.col("p_partkey").alias("asset"), F.lit("Brand#1").alias("hub"), F.lit(True).alias("add")))
    parents = spark.createDataFrame([("Brand#1", "PROMO"), ("Brand#2", "PROMO")], "hub string, parent string")
    return audits.with_policy(hubs, m, moves, parents, spark.createDataFrame([("Brand#3", False)], "hub string, indexable boolean"))


@query(f"WITH {_POLICY} SELECT * FROM h1")
def t21_policy_hubs(spark: SparkSession, sf: str) -> DataFrame:
    return policy(spark, sf)[0]


@query(f"WITH {_POLICY} SELECT parent AS hub, array_to_string(list_sort(list(hub))[1:8], ',') AS children FROM h1 WHERE indexable AND parent IS NOT NULL GROUP BY 1")
def t21_policy_children(spark: SparkSession, sf: str) -> DataFrame:
    return audits.children_of(policy(spark, sf)[0], 8)


@query("""WITH b AS (SELECT DISTINCT p_brand AS hub, p_type AS related FROM part WHERE p_size >= 48), d AS (SELECT hub, related FROM b UNION SELECT related, hub FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY related) AS rn FROM d), k AS (SELECT hub, list_sort(list(related)) AS l FROM r WHERE rn <= 5 GROUP BY 1), h AS (SELECT DISTINCT p_brand AS hub, 'Brand#1' AS own FROM part UNION SELECT DISTINCT p_type, 'Brand#1' FROM part)
SELECT h.hub, array_to_string(CASE WHEN list_contains(coalesce(l, []), own) THEN list_prepend(own, list_filter(l, lambda x: x <> own)) ELSE list_prepend(own, coalesce(l, [])) END[1:5], ',') AS related FROM h LEFT JOIN k ON h.hub = k.hub""")
def t20_promotions(spark: SparkSession, sf: str) -> DataFrame:
    p = part(spark, sf)
    hubs = p.select(F.col("p_brand").alias("hub")).unionByName(p.select(F.col("p_type").alias("hub"))).distinct().withColumn("related", F.array(F.lit("Brand#1")))
    promoted = p.where("p_size >= 48").select(F.col("p_brand").alias("hub"), F.col("p_type").alias("related")).distinct()
    return records.apply_promotions(hubs, promoted, 5).select("hub", F.array_join("related", ",").alias("related"))


@query("""WITH w AS (SELECT p_partkey, unnest(['png', 'pdf']) AS kind, replace(p_name, ' ', '-') || '-' || p_partkey AS stem FROM part), e AS (SELECT *, kind || '/' || stem AS expected FROM w), g AS (SELECT p_partkey, kind, CASE WHEN p_partkey % 41 = 0 THEN 'old/' || stem ELSE expected END AS path FROM e WHERE NOT (kind = 'pdf' AND p_partkey % 31 = 0))
SELECT e.p_partkey, e.kind, expected, path AS actual FROM e LEFT JOIN g ON e.p_partkey = g.p_partkey AND e.kind = g.kind WHERE path IS NULL OR path <> expected""")
def j16_subpaths(spark: SparkSession, sf: str) -> DataFrame:
    items = part(spark, sf).select("p_partkey", F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), _s("p_partkey")).alias("stem"))
    made = items.select("p_partkey", "stem", F.explode(F.array(F.lit("png"), F.lit("pdf"))).alias("kind")).where("not (kind = 'pdf' and p_partkey % 31 = 0)")
    made = made.select("p_partkey", "kind", F.concat_ws("/", F.when(F.col("p_partkey") % 41 == 0, "old").otherwise(F.col("kind")), "stem").alias("path"))
    return audits.subpath_faults(items, ["png", "pdf"], "p_partkey", "stem", made)


@query("""WITH l AS (SELECT p_brand AS page, p_partkey AS item, 0 AS part, 51 - p_size AS spot FROM part WHERE p_size > 45 UNION ALL SELECT p_brand, p_partkey, 1, p_partkey FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_brand, p_partkey, 2, p_partkey FROM part), f AS (SELECT page, item, min((part, spot)) AS o FROM l WHERE item % 10 <> 9 GROUP BY 1, 2)
SELECT page, item, position FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY o, item) AS position FROM f) WHERE position <= 48""")
def r10_page_lists(spark: SparkSession, sf: str) -> DataFrame:
    p, key = part(spark, sf), F.col("p_partkey")
    row = lambda rows, n, at: rows.select(F.col("p_brand").alias("page"), key.alias("item"), F.lit(n).alias("part"), at.cast("bigint").alias("at"))
    lists = row(p.where("p_size > 45"), 0, 51 - F.col("p_size")).unionByName(row(p.where(key % 7 == 0), 1, key)).unionByName(row(p, 2, key))
    return audits.page_lists(lists, "page", "item", p.where(key % 10 != 9).select(key.alias("item")), 48)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN lower(p_type) || '-item' ELSE replace(p_name, ' ', '-') END AS stem FROM part""")
def n14_clean_stems(spark: SparkSession, sf: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 5 == 0, F.lit("export final")).otherwise(F.concat(F.lit("final "), F.col("p_name"), F.lit(" export")))
    return part(spark, sf).select("p_partkey", text.clean_stem(name, F.concat(F.col("p_type"), F.lit(" item")), ["export", "final"]).alias("stem"))


@query("""WITH d AS (SELECT 'parts' AS name, count(*) AS n FROM part UNION ALL SELECT 'brands', count(DISTINCT p_brand) FROM part) SELECT 'parts' AS name, true AS matches UNION ALL SELECT 'brands', false""")
def q17_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of parts against one of the same rows in another order, that of brands against one with a member more."""
    p = part(spark, sf).select("p_partkey", "p_name", "p_brand")
    digest = lambda d, name: records.protected_digest(d, "p_partkey", ["p_brand"]).select(F.lit(name).alias("name"), "digest")
    more = p.where("p_partkey = 0").withColumn("p_partkey", F.lit(-1).cast("bigint"))
    now = digest(p, "parts").unionByName(digest(p, "brands"))
    approved = digest(p.orderBy(F.desc("p_partkey")), "parts").unionByName(digest(p.unionByName(more), "brands"))
    return records.against_baseline(now, approved).select("name", "matches")
