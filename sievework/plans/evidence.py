"""Queries over evidence of candidates, related candidates, promotion by two thresholds, relations, routes, intent, suffixes and acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import audits, chains, gates, linkgraph, overlap, taxonomy
from sievework.plans.curation import _PAIRS, membership
from sievework.plans.lists import _FOREST, _forest
from sievework.plans.mining import _CAND, VOCABULARY, part_signals
from sievework.plans.registry import ORACLES, query
from sievework.plans.site import _EDGES, SITE, items, parsed
from sievework.session import cut, table

_EV = f"""{_CAND}, m AS (SELECT DISTINCT hub, asset FROM c JOIN g USING (dim, term)), bc AS (SELECT hub, p_brand AS v, count(*) AS n, row_number() OVER (PARTITION BY hub ORDER BY count(*) DESC, p_brand) AS rn FROM m JOIN part ON p_partkey = asset GROUP BY 1, 2),
bt AS (SELECT hub, g.dim AS d, g.term AS v, count(*) AS n, row_number() OVER (PARTITION BY hub, g.dim ORDER BY count(*) DESC, g.term) AS rn FROM m JOIN g USING (asset) GROUP BY 1, 2, 3)"""


def _listed(col: str) -> F.Column:
    return F.coalesce(F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["value"], x["n"].cast("string"))), ","), F.lit(""))


def _evidence(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = cut(part_signals(spark, sf))
    cands = cut(taxonomy.candidates(found, 10))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("asset"), F.col("p_brand").alias("category"), F.concat(F.lit("/parts/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("file"))
    return found, cands, taxonomy.full_evidence(found, cands, rows, ["subject", "style", "theme"], 3, 5, 12)


_OF = "(SELECT string_agg(v || ':' || n, ',' ORDER BY rn) FROM bt WHERE bt.hub = c.hub AND d = '{0}' AND rn <= 3)"


@query(f"""WITH {_EV} SELECT c.hub, (SELECT count(*) FROM bc WHERE bc.hub = c.hub) AS categories, coalesce((SELECT string_agg(v || ':' || n, ',' ORDER BY rn) FROM bc WHERE bc.hub = c.hub AND rn <= 5), '') AS top_categories, coalesce({_OF.format('subject')}, '') AS subject, coalesce({_OF.format('style')}, '') AS style, coalesce({_OF.format('theme')}, '') AS theme,
(SELECT string_agg('/parts/' || asset || '.png', ',' ORDER BY asset) FROM (SELECT hub, asset, row_number() OVER (PARTITION BY hub ORDER BY asset) AS rn FROM m) x WHERE x.hub = c.hub AND rn <= 12) AS examples FROM c""")
def t04_candidate_evidence(spark: SparkSession, sf: str) -> DataFrame:
    e = _evidence(spark, sf)[2]
    return e.select("hub", "categories", *(_listed(c).alias(c) for c in ("top_categories", "subject", "style", "theme")), F.array_join(F.transform("examples", lambda x: x["file"]), ",").alias("examples"))


_TERMS = "vt AS (SELECT dim || ':' || term AS hub, unnest([term, alias, parent]) AS w FROM v), ht AS (SELECT DISTINCT c.hub, w FROM c JOIN vt USING (hub) WHERE w IS NOT NULL UNION SELECT hub, term FROM c)"


@query(f"""WITH {_EV}, {_TERMS}, ct AS (SELECT hub, v FROM bc WHERE rn <= 5), r AS (SELECT a.hub, b.hub AS other, count(*) * 10 AS p FROM ht a JOIN ht b ON a.w = b.w AND a.hub <> b.hub GROUP BY 1, 2 UNION ALL SELECT a.hub, b.hub, count(*) * 2 FROM ct a JOIN ct b ON a.v = b.v AND a.hub <> b.hub GROUP BY 1, 2 UNION ALL SELECT a.hub, b.hub, least(8, count(*) // 20) FROM m a JOIN m b ON a.asset = b.asset AND a.hub <> b.hub GROUP BY 1, 2),
s AS (SELECT hub, other, CAST(sum(p) AS BIGINT) AS score FROM r GROUP BY 1, 2 HAVING sum(p) > 0) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY score DESC, other) AS rank FROM s) WHERE rank <= 10""")
def t07_related_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """A candidate's terms are its own, their aliases and parents; its categories the five commonest."""
    found, cands, e = _evidence(spark, sf)
    vocabulary = spark.createDataFrame(VOCABULARY, "dim string, term string, alias string, parent string")
    terms = cands.join(vocabulary.select("dim", "term", F.explode(F.array("alias", "parent")).alias("w")), ["dim", "term"]).select("hub", F.col("w").alias("term")).unionByName(cands.select("hub", "term"))
    categories = e.select("hub", F.explode(F.transform("top_categories", lambda x: x["value"])).alias("category"))
    return taxonomy.related_candidates(terms, categories, cands.join(found, ["dim", "term"]).select("hub", "asset"))


_GREEDY = """o AS (SELECT hub, score, row_number() OVER (ORDER BY score DESC, hub) AS turn FROM z), b AS (SELECT o.hub, o.score, o.turn, coalesce(l, []) AS l FROM o LEFT JOIN (SELECT hub, list(other) AS l FROM near GROUP BY hub) x ON x.hub = o.hub),
w AS (SELECT CAST(0 AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS hub, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS state, CAST([] AS VARCHAR[]) AS kept
UNION ALL SELECT b.turn, b.hub, b.score, CASE WHEN len(list_intersect(b.l, w.kept)) > 0 THEN 'redundant' WHEN len(w.kept) >= 12 THEN 'over-cap' ELSE 'selected' END, CASE WHEN len(list_intersect(b.l, w.kept)) > 0 OR len(w.kept) >= 12 THEN w.kept ELSE list_append(w.kept, b.hub) END FROM w JOIN b ON b.turn = w.turn + 1)
SELECT hub, score, state FROM w WHERE hub IS NOT NULL"""


@query(f"""WITH RECURSIVE {_PAIRS}, k AS (SELECT hub, hub LIKE 'Brand%' AS mixed FROM s), near AS (SELECT d.hub, d.other FROM d JOIN k a ON a.hub = d.hub JOIN k b ON b.hub = d.other WHERE (greatest(hub_size, other_size) <= least(hub_size, other_size) * 1.35 AND common / least(hub_size, other_size) >= 0.9) OR (a.mixed AND NOT b.mixed AND common / least(hub_size, other_size) >= 0.92)),
z AS (SELECT hub, CAST(n AS DOUBLE) AS score FROM s), {_GREEDY}""")
def t12_two_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Brands count as combinations, types do not."""
    m = membership(spark, sf)
    both = overlap.both_ways(overlap.pairs(m))
    sizes = cut(m.groupBy("hub").agg(F.count("*").cast("double").alias("score")))
    near = taxonomy.redundant_pairs(both, sizes.select("hub", F.col("hub").startswith("Brand").alias("combination")))
    return taxonomy.greedy_promotion(sizes, near, 0.0, 12)


#: The single threshold of ``mining.t12_greedy_promotion``, by the same loop.
ORACLES["t12_greedy_promotion"] = f"WITH RECURSIVE {_PAIRS}, near AS (SELECT hub, other FROM d WHERE common / least(hub_size, other_size) >= 0.9), z AS (SELECT hub, CAST(n AS DOUBLE) AS score FROM s), {_GREEDY}"

_PAIR = "x AS (SELECT 's' || s_suppkey AS l, 's' || (s_suppkey + 1) AS r FROM supplier UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'r' || n_regionkey, 's' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT 'n' || n_nationkey, 's' || n_nationkey FROM nation)"


@query(f"""WITH RECURSIVE {_FOREST}, {_PAIR}, t AS (SELECT hub, [hub] AS path FROM f WHERE p IS NULL UNION ALL SELECT f.hub, list_append(t.path, f.hub) FROM f JOIN t ON f.p = t.hub)
SELECT l AS "left", r AS "right", CASE WHEN a.parent = r THEN 'child' WHEN b.parent = l THEN 'parent' WHEN a.parent = b.parent THEN 'siblings' WHEN list_contains(ta.path, r) AND l <> r THEN 'descendant' WHEN list_contains(tb.path, l) AND l <> r THEN 'ancestor' ELSE 'other' END AS relation
FROM x LEFT JOIN f0 a ON a.hub = l LEFT JOIN f0 b ON b.hub = r LEFT JOIN t ta ON ta.hub = l LEFT JOIN t tb ON tb.hub = r""")
def d06_family_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers beside the next one, their nation and their region, and nations beside suppliers of their number, in the forest of ``g5_intervals``."""
    name = lambda mark, c: F.concat(F.lit(mark), (F.col(c) if isinstance(c, str) else c).cast("string"))
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    pair = lambda df, a, b: df.select(a.alias("left"), b.alias("right"))
    pairs = pair(s, name("s", "s_suppkey"), name("s", F.col("s_suppkey") + 1)).unionByName(pair(s, name("s", "s_suppkey"), name("n", "s_nationkey")))
    pairs = pairs.unionByName(pair(s.join(n, F.col("s_nationkey") == F.col("n_nationkey")), name("r", "n_regionkey"), name("s", "s_suppkey"))).unionByName(pair(n, name("n", "n_nationkey"), name("s", "n_nationkey")))
    return chains.relations(pairs.distinct(), _forest(spark, sf), "hub", "parent")


@query(f"""WITH RECURSIVE {_FOREST}, h0 AS (SELECT hub, CASE WHEN hub LIKE 'r%' THEN 'top' ELSE parent END AS parent FROM f0 UNION ALL SELECT 'top', NULL UNION ALL SELECT 'alone', NULL),
sl AS (SELECT hub, CASE WHEN hub LIKE 'n%' AND CAST(substr(hub, 2) AS INT) % 7 = 3 THEN '' WHEN hub LIKE 's%' AND CAST(substr(hub, 2) AS INT) % 8 IN (6, 7) THEN 's' || (CAST(substr(hub, 2) AS INT) % 8) ELSE hub END AS slug FROM h0),
t AS (SELECT hub, hub AS top, [hub] AS path, '' AS route, false AS bare, CAST(0 AS BIGINT) AS depth FROM h0 WHERE parent IS NULL UNION ALL SELECT h0.hub, t.top, list_append(t.path, h0.hub), t.route || '/' || sl.slug, t.bare OR sl.slug = '', t.depth + 1 FROM h0 JOIN t ON h0.parent = t.hub JOIN sl ON sl.hub = h0.hub),
e AS (SELECT hub, path, CASE WHEN depth = 0 THEN '/' ELSE route END AS route, bare, depth FROM t WHERE top = 'top'), tk AS (SELECT hub FROM (SELECT hub, row_number() OVER (PARTITION BY route ORDER BY hub) AS rn FROM e WHERE NOT bare) WHERE rn > 1),
br AS (SELECT hub FROM tk UNION SELECT e.hub FROM e JOIN sl ON sl.hub = e.hub WHERE slug = '' AND depth > 0), bl AS (SELECT DISTINCT e.hub FROM e JOIN br ON list_contains(e.path, br.hub) AND br.hub <> e.hub),
dg AS (SELECT hub FROM h0 WHERE parent IS NOT NULL AND parent NOT IN (SELECT hub FROM h0) UNION SELECT h0.hub FROM h0 JOIN dg ON h0.parent = dg.hub),
x AS (SELECT h0.hub, CASE WHEN h0.hub IN (SELECT hub FROM dg) THEN 'dangling' WHEN t.hub IS NULL THEN 'cycle' WHEN t.top <> 'top' THEN 'second-root' WHEN h0.hub IN (SELECT hub FROM bl) THEN 'not-contiguous' WHEN h0.hub IN (SELECT hub FROM tk) THEN 'route-taken' WHEN e.bare THEN 'no-slug' END AS finding, e.route, e.depth FROM h0 LEFT JOIN t ON t.hub = h0.hub LEFT JOIN e ON e.hub = h0.hub)
SELECT hub, CASE WHEN finding IS NULL THEN route END AS route, CASE WHEN finding IS NULL THEN depth END AS depth, CASE WHEN finding IS NULL THEN row_number() OVER (PARTITION BY finding IS NULL ORDER BY route) - 1 END AS position, finding FROM x""")
def t10_routes_from_root(spark: SparkSession, sf: str) -> DataFrame:
    """The forest of ``g5_intervals`` under one root, with a second root, nations without slugs and suppliers whose slugs repeat."""
    f = _forest(spark, sf).withColumn("parent", F.when(F.col("hub").startswith("r"), "top").otherwise(F.col("parent")))
    f = cut(f.unionByName(spark.createDataFrame([("top", None), ("alone", None)], "hub string, parent string")))
    k = F.expr("try_cast(substring(hub, 2, 9) as int)")
    slug = F.when(F.col("hub").rlike("^n[0-9]") & (k % 7 == 3), "").when(F.col("hub").rlike("^s[0-9]") & (k % 8).isin(6, 7), F.concat(F.lit("s"), (k % 8).cast("string"))).otherwise(F.col("hub"))
    paths = linkgraph.ancestor_paths(f.select(F.col("hub").alias("node"), "parent"))
    plan = chains.route_plan(paths, f.select("hub", slug.alias("slug")), "top")
    return plan.select("hub", "route", F.col("depth").cast("bigint").alias("depth"), F.col("position").cast("bigint").alias("position"), "finding")


_STOP = ["for", "the", "and", "hardware"]
_SLUGS = f"""sl AS (SELECT hub, replace(hub, ':', '-') AS slug, list_filter(string_split(replace(hub, ':', '-'), '-'), lambda t: length(t) > 2 AND NOT list_contains([{', '.join(f"'{w}'" for w in [*_STOP, 'subject', 'style', 'theme'])}], t)) AS tokens FROM c)"""


@query(f"""WITH {_EV}, {_SLUGS}, q AS (SELECT m.hub, len(tokens) AS k, len(list_filter(tokens, lambda t: contains(lower(p_name || ' ' || p_type), t))) > 0 AS hit FROM m JOIN sl USING (hub) JOIN part ON p_partkey = asset)
SELECT hub, count(*) AS members, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*), 6) AS share, CASE WHEN max(k) = 0 THEN 'no-token' WHEN round(count(*) FILTER (hit) / count(*), 6) < 0.35 THEN 'weak' ELSE 'direct' END AS evidence FROM q GROUP BY hub""")
def t24_intent_evidence(spark: SparkSession, sf: str) -> DataFrame:
    found = cut(part_signals(spark, sf))
    cands = taxonomy.candidates(found, 10)
    titles = table(spark, sf, "part").select(F.col("p_partkey").alias("asset"), F.concat_ws(" ", "p_name", "p_type").alias("title"))
    return taxonomy.intent_evidence(cands.join(found, ["dim", "term"]).select("hub", "asset").distinct(), titles, cands.select("hub", F.replace("hub", F.lit(":"), F.lit("-")).alias("slug")), [*_STOP, "subject", "style", "theme"])


SUFFIXES = [("design", r": Design [0-9]+$"), ("labelled", r"(Version|Page|Variant|Number|Set) [0-9]+$"), ("number", r" [0-9]+$"), ("bracket", r"\([^()]*\)$")]


@query(r"""WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 7 WHEN 0 THEN ': Design ' || p_size WHEN 1 THEN ' Version ' || p_size WHEN 2 THEN ' Set 3' WHEN 3 THEN ' ' || p_size WHEN 4 THEN ' (' || lower(p_type) || ')' ELSE '' END AS title FROM part),
m AS (SELECT p_partkey, CASE WHEN regexp_matches(title, ': Design [0-9]+$') THEN 'design' WHEN regexp_matches(title, '(Version|Page|Variant|Number|Set) [0-9]+$') THEN 'labelled' WHEN regexp_matches(title, ' [0-9]+$') THEN 'number' WHEN regexp_matches(title, '\([^()]*\)$') THEN 'bracket' ELSE 'none' END AS pattern, title FROM t),
s AS (SELECT p_partkey, pattern, regexp_replace(CASE pattern WHEN 'design' THEN regexp_extract(title, ': Design [0-9]+$') WHEN 'labelled' THEN regexp_extract(title, '(Version|Page|Variant|Number|Set) [0-9]+$') WHEN 'number' THEN regexp_extract(title, ' [0-9]+$') WHEN 'bracket' THEN regexp_extract(title, '\([^()]*\)$') ELSE '' END, '[0-9]+', '#', 'g') AS suffix FROM m)
SELECT pattern, suffix, count(*) AS n, array_to_string(list(p_partkey ORDER BY p_partkey)[1:3], ',') AS examples FROM s GROUP BY 1, 2""")
def q19_named_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    """Titles with variant suffixes of several kinds, by key."""
    k, size = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    tail = F.when(k == 0, F.concat(F.lit(": Design "), size)).when(k == 1, F.concat(F.lit(" Version "), size)).when(k == 2, " Set 3").when(k == 3, F.concat(F.lit(" "), size)).when(k == 4, F.concat(F.lit(" ("), F.lower("p_type"), F.lit(")"))).otherwise("")
    rows = table(spark, sf, "part").select("p_partkey", F.concat("p_name", tail).alias("title"))
    return gates.suffix_tally(rows, "p_partkey", "title", SUFFIXES).withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


LADDER = [("needs-copy-fix", ["structured fault"]), ("needs-count-fix", ["count mismatch"]), ("needs-route-fix", ["broken link", "orphaned item"]), ("should-demote", ["below minimum"])]


@query(f"""WITH {_EDGES}, hb AS (SELECT hub, count(*) AS members, max(p_brand) AS brand FROM r GROUP BY hub), bk AS (SELECT DISTINCT r.hub FROM e JOIN r ON r.route = e.src WHERE e.region = 'related' AND e.dst NOT IN (SELECT route FROM n)),
sh AS (SELECT r.hub, count(*) AS shown FROM r WHERE k % 29 <> 0 GROUP BY r.hub), ib AS (SELECT DISTINCT r.hub FROM r LEFT JOIN (SELECT DISTINCT dst FROM e WHERE region IN ('gallery-card', 'related', 'content') AND src <> dst) c ON c.dst = r.route WHERE c.dst IS NULL),
st AS (SELECT DISTINCT hub FROM r WHERE k % 19 = 0 AND k % 23 = 0), p AS (SELECT hb.hub, members, list_filter([CASE WHEN bk.hub IS NOT NULL THEN 'broken link' END, CASE WHEN coalesce(shown, 0) <> members THEN 'count mismatch' END, CASE WHEN ib.hub IS NOT NULL THEN 'orphaned item' END, CASE WHEN st.hub IS NOT NULL THEN 'structured fault' END, CASE WHEN members < 8 THEN 'below minimum' END], lambda x: x IS NOT NULL) AS l
  FROM hb LEFT JOIN bk ON bk.hub = hb.hub LEFT JOIN sh ON sh.hub = hb.hub LEFT JOIN ib ON ib.hub = hb.hub LEFT JOIN st ON st.hub = hb.hub)
SELECT hub, CASE WHEN list_contains(l, 'below minimum') THEN 'should-demote' WHEN list_contains(l, 'broken link') OR list_contains(l, 'orphaned item') THEN 'needs-route-fix' WHEN list_contains(l, 'count mismatch') THEN 'needs-count-fix' WHEN list_contains(l, 'structured fault') THEN 'needs-copy-fix' WHEN members % 2 = 1 THEN 'owner-review-needed' ELSE 'accepted' END AS status, array_to_string(list_sort(l), ',') AS problems FROM p""")
def q10_site_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    """Acceptance of each brand's listing from what the site's audits find: broken links of its items' pages, cards against members, items that no content links, pages with two structured-data faults."""
    read = parsed(spark, sf)
    anchors = cut(linkgraph.anchors_of(read, SITE))
    own = cut(items(spark, sf).select(F.col("route").alias("item"), "hub", F.col("listed").alias("hub_page"), "k"))
    by = own.select(F.col("item").alias("page"), "hub")
    broken = linkgraph.link_findings(anchors.where("region = 'related'"), read).where("finding = 'broken'").join(by, "page").select("hub", F.lit("broken link").alias("problem"))
    cards = anchors.where("region = 'gallery-card'").select(F.col("target").alias("item")).distinct().join(own, "item").groupBy("hub").agg(F.count("*").alias("shown"))
    sizes = own.groupBy("hub").agg(F.count("*").alias("members"))
    counts = sizes.join(cards, "hub", "left").where(F.coalesce("shown", F.lit(0)) != F.col("members")).select("hub", F.lit("count mismatch").alias("problem"))
    lost = linkgraph.item_findings(own.select("item", "hub_page", "hub"), read.select("page"), anchors.where("page <> target"), ["gallery-card", "related", "content"]).where("finding = 'no-content-inbound'").join(own.select("item", "hub"), "item").select("hub", F.lit("orphaned item").alias("problem"))
    faults = linkgraph.structured_findings(read, ["BreadcrumbList", "ImageObject", "ItemList"], ["Offer"], "https://schema.org").where("finding in ('forbidden-type', 'relative-url')").groupBy("page").agg(F.count_distinct("finding").alias("n")).where("n = 2")
    faults = faults.join(by, "page").select("hub", F.lit("structured fault").alias("problem"))
    small = sizes.where("members < 8").select("hub", F.lit("below minimum").alias("problem"))
    found = broken.unionByName(counts).unionByName(lost).unionByName(faults).unionByName(small).groupBy("hub").agg(F.collect_set("problem").alias("problems"))
    rows = sizes.join(found, "hub", "left").withColumn("problems", F.coalesce("problems", F.array().cast("array<string>")))
    return audits.acceptance(rows, "hub", F.col("problems"), LADDER, F.col("members") % 2 == 1)
