"""Queries over claims, paragraphs, concepts, digest trees, forests and page chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators import chains, claims, concepts, digests, linkgraph, neardup
from sievework.plans.registry import query
from sievework.plans.scalars import _MATCH, _WORDS
from sievework.plans.site import _EDGES, SITE, parsed
from sievework.session import table

# claims ---------------------------------------------------------------------------------------------------------

_HUBS = """m AS (SELECT 'b' || p_brand AS hub, p_partkey AS item FROM part UNION ALL SELECT 't' || p_type, p_partkey FROM part UNION ALL SELECT 's' || p_size, p_partkey FROM part UNION ALL SELECT 'n' || p_name, p_partkey FROM part WHERE p_partkey % 3 = 0),
h AS (SELECT hub, list(item ORDER BY item) AS items, row_number() OVER (ORDER BY count(*) DESC, hub) AS turn FROM m GROUP BY hub)"""


@query(f"""WITH RECURSIVE {_HUBS}, c AS (SELECT 0 AS turn, CAST(NULL AS VARCHAR) AS hub, CAST(NULL AS BIGINT) AS item, CAST([] AS BIGINT[]) AS taken
UNION ALL SELECT x.turn, x.hub, x.pick, CASE WHEN x.pick IS NULL THEN x.taken ELSE list_append(x.taken, x.pick) END FROM (SELECT h.turn, h.hub, c.taken, list_filter(h.items, lambda i: NOT list_contains(c.taken, i))[1]::BIGINT AS pick FROM c JOIN h ON h.turn = c.turn + 1) x),
r AS (SELECT p.p_partkey AS item, c.hub, c.turn, CASE WHEN c.hub IS NOT NULL THEN 0 WHEN p_size >= 49 THEN 1 ELSE 2 END AS rank FROM part p LEFT JOIN c ON c.item = p.p_partkey)
SELECT item, CASE rank WHEN 0 THEN 'hub' WHEN 1 THEN 'flagged' ELSE 'fill' END AS reason, hub FROM r ORDER BY rank, turn, item LIMIT 100""")
def w22_claimed_representatives(spark: SparkSession, sf: str) -> DataFrame:
    """Every part is in the hubs of its brand, type and size, and each third in that of its name."""
    p = table(spark, sf, "part")
    hub = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string")).alias("hub")
    rows = [p.select(hub("b", "p_brand"), "p_partkey"), p.select(hub("t", "p_type"), "p_partkey"), p.select(hub("s", "p_size"), "p_partkey"), p.where("p_partkey % 3 = 0").select(hub("n", "p_name"), "p_partkey")]
    members = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return claims.representatives(members, "hub", "p_partkey", F.col("p_partkey"), p.select("p_partkey", "p_size"), F.col("p_size") >= 49, 100)


# paragraphs -----------------------------------------------------------------------------------------------------


def _near(only: str, least: float) -> str:
    tokens = _WORDS.format(_MATCH.format("line"))
    share = 2 * least / (1 + least)
    return f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS ln FROM documents),
p AS (SELECT doc_id, ln, list_sort(list_distinct({tokens})) AS s FROM l WHERE {only}), k AS (SELECT min({{'doc': doc_id, 'ln': ln}}) AS id, s FROM p WHERE len(s) >= 6 GROUP BY s),
f AS (SELECT w, count(*) AS df FROM (SELECT unnest(s) AS w FROM k) GROUP BY w), o AS (SELECT id, s, len(s) AS n, w, row_number() OVER (PARTITION BY id ORDER BY df, w) AS pos FROM (SELECT id, s, unnest(s) AS w FROM k) JOIN f USING (w)),
c AS (SELECT DISTINCT a.id AS l, b.id AS r FROM o a JOIN o b ON a.w = b.w AND (a.n < b.n OR (a.n = b.n AND a.id < b.id)) AND a.n >= {least} * b.n - 1e-9 WHERE a.pos <= a.n - ceil({share} * a.n - 1e-9) + 1 AND b.pos <= b.n - ceil({least} * b.n - 1e-9) + 1),
j AS (SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, len(list_intersect(x.s, y.s)) AS common, len(x.s) + len(y.s) AS total FROM c JOIN k x ON x.id = c.l JOIN k y ON y.id = c.r)
SELECT a.doc AS left_doc, a.ln AS left_at, b.doc AS right_doc, b.ln AS right_at, round(common / (total - common), 4) AS similarity FROM j WHERE common / (total - common) >= {least}"""


def _near_lines(spark: SparkSession, sf: str, most: int | None, least: float) -> DataFrame:
    """Paragraphs end at line breaks; those of one token set are one class, named by its first place; null texts have none."""
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = (docs if most is None else docs.where(F.col("at") < most)).select(F.struct(F.col("doc_id").alias("doc"), F.col("at").cast("bigint").alias("at")).alias("place"), "line")
    classes = neardup.token_representatives(rows, "place", text.match_words(F.col("line")), 6)
    found = neardup.jaccard_pairs(classes, least, words=4)
    return found.select(F.col("left.doc").alias("left_doc"), F.col("left.at").alias("left_at"), F.col("right.doc").alias("right_doc"), F.col("right.at").alias("right_at"), F.round("jaccard", 4).alias("similarity"))


@query(_near("true", 0.76))
def d10_near_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return _near_lines(spark, sf, None, 0.76)


@query(_near("ln = 0", 0.68))
def d10_near_intros(spark: SparkSession, sf: str) -> DataFrame:
    return _near_lines(spark, sf, 1, 0.68)


# concepts -------------------------------------------------------------------------------------------------------

_CONCEPTS = """q AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), k AS (SELECT DISTINCT item_id AS concept, w[i] || ' ' || w[i + 1] AS term FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM q) WHERE w[i] <> '' AND w[i + 1] <> ''),
s AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents), b AS (SELECT doc_id, text, i, w[i] || ' ' || w[i + 1] AS term, w FROM (SELECT *, unnest(range(1, len(w))) AS i FROM s)),
h AS (SELECT doc_id, term, CAST(CASE WHEN i = 1 THEN 0 ELSE length(array_to_string(w[1:i - 1], ' ')) + 1 END AS INT) AS start, text FROM b WHERE term IN (SELECT term FROM k)),
x AS (SELECT doc_id AS id, term, start, substr(text, greatest(0, start - 20) + 1, start + length(term) + 20 - greatest(0, start - 20)) AS context FROM h)"""


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    """Two words that stand side by side in a benchmark item speak for the item."""
    words = F.split("text", " ")
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    some = table(spark, sf, "benchmark").where(F.size(words) > 1)
    return some.select(F.col("item_id").alias("concept"), F.explode(pairs).alias("term")).where("not startswith(term, ' ') and not endswith(term, ' ')").distinct()


@query(f"WITH {_CONCEPTS} SELECT id, term, start, md5(context) AS context FROM x")
def t17_term_places(spark: SparkSession, sf: str) -> DataFrame:
    found = concepts.term_places(table(spark, sf, "documents"), _terms(spark, sf), "doc_id", "text", " ")
    return found.select("id", "term", "start", F.md5("context").alias("context"))


@query(f"""WITH {_CONCEPTS}, d AS (SELECT concept, id, count(*) AS n, min({{'start': start, 'term': x.term, 'context': context}}) AS first FROM x JOIN k ON k.term = x.term GROUP BY 1, 2),
e AS (SELECT concept, sum(n)::BIGINT AS hits, count(*) AS rows, list(id || ':' || first.start || ':' || first.term ORDER BY id) AS l FROM d GROUP BY concept), u AS (SELECT concept, count(DISTINCT x.term) AS terms FROM x JOIN k ON k.term = x.term GROUP BY 1)
SELECT c.concept, coalesce(hits, 0) AS hits, coalesce(rows, 0) AS rows, coalesce(terms, 0) AS terms, coalesce(rows, 0) >= 8 AS supported, coalesce(array_to_string(l[1:8], '|'), '') AS examples FROM (SELECT DISTINCT concept FROM k) c LEFT JOIN e ON e.concept = c.concept LEFT JOIN u ON u.concept = c.concept""")
def t17_concept_evidence(spark: SparkSession, sf: str) -> DataFrame:
    found = concepts.concept_evidence(table(spark, sf, "documents"), _terms(spark, sf), "doc_id", "text", 8, edges=" ")
    told = F.array_join(F.transform("examples", lambda x: F.concat_ws(":", x["id"].cast("string"), x["start"].cast("string"), x["term"])), "|")
    return found.withColumn("examples", F.coalesce(told, F.lit("")))


# digest trees ---------------------------------------------------------------------------------------------------

_HEX = "CAST('0x' || substr({}, {}, 12) AS BIGINT)"
_SUMS = f"count(*) AS n, sum({_HEX.format('l', 1)})::HUGEINT AS a, sum({_HEX.format('l', 13)})::HUGEINT AS b"


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    p = parsed(spark, sf)
    a = linkgraph.resolved(p, SITE)
    findings = linkgraph.link_findings(a, p)
    return {"nodes": p.select("page"), "edges": linkgraph.edges_of(a).select("src", "dst", "n"), "findings": findings.select("page", "target", "finding")}


@query(f"""WITH {_EDGES}, t AS (SELECT 'nodes' AS name, md5(route) AS l FROM n UNION ALL SELECT 'edges', md5(src || chr(1) || dst || chr(1) || k) FROM (SELECT src, dst, count(*) AS k FROM e GROUP BY 1, 2)
UNION ALL SELECT 'findings', md5(src || chr(1) || dst || chr(1) || 'broken') FROM (SELECT DISTINCT src, dst FROM e) WHERE dst NOT IN (SELECT route FROM n)), g AS (SELECT name, {_SUMS} FROM t GROUP BY name)
SELECT name, n, sha256(n || ':' || a || ':' || b) AS digest FROM g""")
def lg17_graph_digests(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    return digests.table_digests({"nodes": (t["nodes"], ["page"], []), "edges": (t["edges"], ["src", "dst"], ["n"]), "findings": (t["findings"], ["page", "target"], ["finding"])})


@query("""WITH a AS (SELECT substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 3) AS range, count(*) AS n, count(*) FILTER (o_orderkey % 4001 = 17) AS changed, count(*) FILTER (o_orderkey % 5003 = 5) AS gone FROM orders GROUP BY 1)
SELECT range, n AS n_before, n - gone AS n_after FROM a WHERE changed + gone > 0""")
def lg17_changed_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of one table, the second with some rows changed and some gone: the ranges of keys that name them."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    later = o.where("o_orderkey % 5003 <> 5").withColumn("o_custkey", F.when(F.col("o_orderkey") % 4001 == 17, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    trees = [digests.tree(t, ["o_orderkey"], ["o_custkey", "o_orderstatus"], depth=3) for t in (o, later)]
    return digests.changed_ranges(*trees, depth=3)


# forests --------------------------------------------------------------------------------------------------------

_FOREST = """f0 AS (SELECT 'r' || r_regionkey AS hub, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT 's' || s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 's' || (s_suppkey + 1) WHEN 1 THEN 's' || (s_suppkey - 1) WHEN 2 THEN 's' || (s_suppkey - 1) WHEN 3 THEN 'nowhere' WHEN 4 THEN 's' || (s_suppkey + 1) ELSE 'n' || s_nationkey END FROM supplier),
f AS (SELECT hub, parent, CASE WHEN parent IN (SELECT hub FROM f0) THEN parent END AS p FROM f0)"""


def _forest(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, nations and suppliers; of eight suppliers two are each other's parents, one hangs below them, one names an unknown parent and one another supplier."""
    name = lambda mark, c: F.concat(F.lit(mark), (F.col(c) if isinstance(c, str) else c).cast("string"))
    k = F.col("s_suppkey")
    parent = F.when(k % 8 == 0, name("s", k + 1)).when((k % 8 == 1) | (k % 8 == 2), name("s", k - 1)).when(k % 8 == 3, "nowhere").when(k % 8 == 4, name("s", k + 1)).otherwise(name("n", "s_nationkey"))
    r = table(spark, sf, "region").select(name("r", "r_regionkey").alias("hub"), F.lit(None).cast("string").alias("parent"))
    n = table(spark, sf, "nation").select(name("n", "n_nationkey").alias("hub"), name("r", "n_regionkey").alias("parent"))
    return r.unionByName(n).unionByName(table(spark, sf, "supplier").select(name("s", k).alias("hub"), parent.alias("parent")))


@query(f"""WITH RECURSIVE {_FOREST}, t AS (SELECT hub, hub AS root, [hub] AS path FROM f WHERE p IS NULL UNION ALL SELECT f.hub, t.root, list_append(t.path, f.hub) FROM f JOIN t ON f.p = t.hub),
o AS (SELECT hub, root, path, 2 * (row_number() OVER (PARTITION BY root ORDER BY path) - 1) - (len(path) - 1) AS enters FROM t), s AS (SELECT a.hub, count(*) AS size FROM t a JOIN t b ON list_contains(b.path, a.hub) GROUP BY 1)
SELECT f.hub, root, CAST(enters AS BIGINT) AS enters, CAST(enters + 2 * size - 1 AS BIGINT) AS leaves FROM f LEFT JOIN o ON o.hub = f.hub LEFT JOIN s ON s.hub = f.hub""")
def g5_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return chains.intervals(_forest(spark, sf), "hub", "parent")


_LISTED = f"""{_FOREST}, c AS (SELECT parent AS hub, list(hub ORDER BY hub) AS l FROM f0 WHERE parent IS NOT NULL GROUP BY 1),
h AS (SELECT f0.hub, f0.parent, CASE WHEN f0.hub NOT LIKE 'n%' THEN coalesce(l, []) ELSE CASE CAST(substr(f0.hub, 2) AS INT) % 5 WHEN 0 THEN list_reverse(coalesce(l, [])) WHEN 1 THEN list_concat(coalesce(l, []), coalesce(l, [])[1:1]) WHEN 2 THEN coalesce(l, [])[2:] WHEN 3 THEN list_concat(coalesce(l, []), ['zzz', 'r0']) ELSE coalesce(l, []) END END AS l FROM f0 LEFT JOIN c ON c.hub = f0.hub),
u AS (SELECT hub, unnest(l) AS other, unnest(range(len(l))) AS ln FROM h),
ok AS (SELECT hub FROM f WHERE p IS NULL UNION SELECT f.hub FROM f JOIN ok ON f.p = ok.hub)"""


@query(f"""WITH RECURSIVE {_LISTED}
SELECT hub, parent AS other, 'unknown-parent' AS finding FROM h WHERE parent IS NOT NULL AND parent NOT IN (SELECT hub FROM h)
UNION SELECT hub, other, 'unknown-child' FROM u WHERE other NOT IN (SELECT hub FROM h) UNION SELECT u.hub, other, 'other-parent' FROM u JOIN h x ON x.hub = u.other WHERE x.parent IS DISTINCT FROM u.hub
UNION SELECT parent, hub, 'unlisted-child' FROM h WHERE parent IN (SELECT hub FROM h) AND NOT EXISTS (SELECT 1 FROM u WHERE u.hub = h.parent AND u.other = h.hub)
UNION SELECT hub, other, 'listed-twice' FROM u GROUP BY hub, other HAVING count(*) > 1 UNION SELECT a.hub, a.other, 'out-of-order' FROM u a JOIN u b ON a.hub = b.hub AND b.ln < a.ln AND b.other > a.other
UNION SELECT hub, CAST(NULL AS VARCHAR), 'cycle' FROM h WHERE hub NOT IN (SELECT hub FROM ok)""")
def g5_family_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Nations' lists of children are reversed, repeat one, leave one out or name strangers, by number."""
    f = _forest(spark, sf)
    own = f.where("parent is not null").groupBy(F.col("parent").alias("hub")).agg(F.array_sort(F.collect_list("hub")).alias("l"))
    k = F.when(F.col("hub").startswith("n"), F.substring("hub", 2, 9).cast("int") % 5)
    some = F.coalesce("l", F.array().cast("array<string>"))
    said = F.when(k == 0, F.reverse(some)).when(k == 1, F.concat(some, F.slice(some, 1, 1))).when(k == 2, F.slice(some, 2, 1 << 30)).when(k == 3, F.concat(some, F.array(F.lit("zzz"), F.lit("r0")))).otherwise(some)
    return chains.family_findings(f.join(own, "hub", "left").withColumn("children", said), "hub", "parent", "children")


# page chains ----------------------------------------------------------------------------------------------------

LISTED = 5
_CHAINS = f"""i AS (SELECT p_partkey AS k, '/' || replace(lower(p_brand), '#', '-') AS chain, CAST(replace(p_brand, 'Brand#', '') AS INT) % 6 AS fault, CAST(ceil(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) / {LISTED}) AS BIGINT) AS number FROM part),
p0 AS (SELECT DISTINCT chain, fault, number FROM i), sz AS (SELECT chain, max(number) AS size FROM p0 GROUP BY 1), nm AS (SELECT p0.chain, fault, number, size, CASE WHEN number = 1 THEN p0.chain ELSE p0.chain || '/page/' || number END AS page FROM p0 JOIN sz ON sz.chain = p0.chain),
there AS (SELECT * FROM nm WHERE NOT (fault = 4 AND number = 2)), route AS (SELECT chain, number, page FROM nm),
l AS (SELECT page AS src, chain || CASE WHEN number = 2 THEN '' ELSE '/page/' || (number - 1) END AS dst FROM there WHERE number > 1 AND NOT (fault = 5 AND number = 2)
UNION SELECT page, chain || '/page/' || (number + 1) FROM there WHERE number < size AND NOT (fault = 1 AND number = 2)
UNION SELECT page, chain FROM there WHERE fault = 2 AND number = size UNION SELECT page, chain || '/page/3' FROM there WHERE fault = 3 AND number = 1 AND size >= 3
UNION SELECT page, '/brand-1' FROM there WHERE fault = 5 AND number = 2 UNION SELECT page, '/nowhere' FROM there WHERE fault = 0 AND number = 3),
m AS (SELECT s.chain, s.page AS src, s.number, d.chain AS dchain, d.number AS k, l.dst FROM l JOIN nm s ON s.page = l.src LEFT JOIN nm d ON d.page = l.dst),
b AS (SELECT src AS page, count(*) FILTER (k > number) AS later, bool_or(k = number + 1) AS nxt, bool_or(k = number - 1) AS back, coalesce(arg_min(dst, k) FILTER (k > number), arg_min(dst, k) FILTER (k < number - 1 OR k = number)) AS go FROM m WHERE dchain = chain GROUP BY src),
r AS (SELECT nm.*, b.later, b.nxt, b.back, b.go FROM nm LEFT JOIN b ON b.page = nm.page),
w AS (SELECT page AS first, page AS here, 0 AS steps FROM nm UNION ALL SELECT w.first, r.go, w.steps + 1 FROM w JOIN r ON r.page = w.here WHERE r.go IS NOT NULL AND w.steps <= (SELECT max(size) FROM sz)),
z AS (SELECT first, max(steps) AS steps, arg_max(here, steps) AS last FROM w GROUP BY first)"""


@query(f"""WITH RECURSIVE {_CHAINS}, bad AS (SELECT DISTINCT i.chain, there.page FROM i JOIN there ON there.chain = i.chain AND there.number = i.number WHERE i.fault = 0 AND i.number = 3 AND k % 2 = 0),
found AS (SELECT chain, src AS page, 'no-page' AS finding FROM m WHERE dchain IS NULL UNION SELECT chain, src, 'foreign' FROM m WHERE dchain <> chain UNION SELECT chain, page, 'back-missing' FROM r WHERE number > 1 AND NOT coalesce(back, false)
UNION SELECT chain, page, 'next-missing' FROM r WHERE number < size AND NOT coalesce(nxt, false) UNION SELECT chain, page, 'fork' FROM r WHERE later > 1 UNION SELECT r.chain, r.page, 'loop' FROM r JOIN z ON z.first = r.page WHERE z.steps > (SELECT max(size) FROM sz)
UNION SELECT r.chain, r.page, 'gap' FROM r JOIN z ON z.first = r.page JOIN nm e ON e.page = z.last WHERE r.number = 1 AND z.steps <= (SELECT max(size) FROM sz) AND (e.number <> r.size OR z.steps <> r.size - 1))
SELECT * FROM found WHERE page IN (SELECT page FROM there) UNION SELECT chain, page, 'missing-pagination-page' FROM nm WHERE fault = 4 AND number = 2 UNION SELECT chain, page, 'pagination-membership-mismatch' FROM bad
UNION SELECT chain, chain, 'hub-membership-sequence-mismatch' FROM (SELECT DISTINCT chain FROM bad UNION SELECT DISTINCT chain FROM nm WHERE fault = 4 AND number = 2)""")
def lg13_linked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Listings of each brand's parts on pages that link on and back, with a fault by the brand's number: a link left out, a last page that leads to the first, a second link on, a page that isn't there, a link to another listing, cards left out."""
    from pyspark.sql import Window

    from sievework.functions import keys

    k = F.col("p_partkey")
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    i = table(spark, sf, "part").select(k.alias("k"), F.concat(F.lit("/"), text.slug(F.col("p_brand"))).alias("chain"), (F.replace("p_brand", F.lit("Brand#")).cast("int") % 6).alias("fault"), F.ceil(F.row_number().over(w) / LISTED).alias("number"))
    i = i.withColumn("page", keys.page_route(F.col("chain"), F.col("number"))).withColumn("item", F.concat(F.lit("/item/"), F.col("k").cast("string")))
    link = lambda href: F.concat(F.lit('<a href="'), href, F.lit('">x</a>'))
    fault, n, size = F.col("fault"), F.col("number"), F.col("size")
    shown = F.collect_list(F.when(~((fault == 0) & (n == 3) & (F.col("k") % 2 == 0)), link(F.col("item"))))
    pages = i.groupBy("chain", "fault", "number", "page").agg(F.array_join(shown, "").alias("cards")).join(i.groupBy("chain").agg(F.max("number").alias("size")), "chain")
    to = lambda c, when: F.when(when, link(c))
    nav = F.concat_ws("", to(keys.page_route(F.col("chain"), n - 1), (n > 1) & ~((fault == 5) & (n == 2))), to(keys.page_route(F.col("chain"), n + 1), (n < size) & ~((fault == 1) & (n == 2))),
        to(F.col("chain"), (fault == 2) & (n == size)), to(keys.page_route(F.col("chain"), F.lit(3)), (fault == 3) & (n == 1) & (size >= 3)), to(F.lit("/brand-1"), (fault == 5) & (n == 2)), to(F.lit("/nowhere"), (fault == 0) & (n == 3)))
    html = F.concat(F.lit('<html><body><main class="card-grid">'), "cards", F.lit('</main><nav class="pagination">'), nav, F.lit("</nav></body></html>"))
    there = pages.where(~((fault == 4) & (n == 2))).select(F.col("page").alias("route"), html.alias("html"))
    read = linkgraph.parse_pages(there)
    return chains.pagination_audit(i.select("chain", "page", "number", "item"), read.select("page"), linkgraph.anchors_of(read, SITE))
