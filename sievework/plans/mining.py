"""Queries over near-duplicates, taxonomy mining, search, recommendation and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import keys, text
from sievework.operators import neardup, overlap, search, taxonomy
from sievework.plans.curation import _PAIRS, membership
from sievework.plans.registry import query
from sievework.plans.scalars import _MATCH, _WORDS
from sievework.session import table
from sievework.streaming import ledgers

_TOK = _WORDS.format(_MATCH.format("text"))


def doc_tokens() -> F.Column:
    return text.match_words(F.col("text"))


@query("SELECT sha256(lower(trim(text))) AS key_hash, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def d01_exact_texts(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.exact_groups(table(spark, sf, "documents"), "doc_id", F.lower(F.trim("text")))


_SETS = f"""t AS (SELECT doc_id, list_sort(list_distinct({_TOK})) AS s FROM documents), c AS (SELECT min(doc_id) AS id, s FROM t WHERE len(s) >= 5 GROUP BY s), w AS (SELECT id, unnest(s) AS w FROM c)"""


@query(f"""WITH {_SETS}, n AS (SELECT id, len(s) AS n FROM c), k AS (SELECT a.id AS "left", b.id AS "right", count(*) AS common FROM w a JOIN w b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2), j AS (SELECT k.*, common / (x.n + y.n - common) AS jaccard FROM k JOIN n x ON x.id = "left" JOIN n y ON y.id = "right") SELECT "left", "right", common, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.68""")
def d02_token_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    classes = neardup.token_representatives(table(spark, sf, "documents"), "doc_id", doc_tokens(), 5)
    return neardup.jaccard_pairs(classes, 0.68, words=4).withColumn("jaccard", F.round("jaccard", 6))


@query(f"""WITH {_SETS} SELECT t.doc_id AS id, c.id AS class_id FROM t JOIN c ON t.s = c.s""")
def d02_token_classes(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.token_classes(table(spark, sf, "documents"), "doc_id", doc_tokens(), 5).select("id", "class_id")


@query(f"""WITH t AS (SELECT doc_id, {_TOK} AS l FROM documents) SELECT array_to_string(l[1:3], ' ') AS opening, count(*) AS n, min(doc_id) AS first FROM t WHERE len(l) >= 3 GROUP BY 1 HAVING count(*) >= 3""")
def d03_openings(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.openings(table(spark, sf, "documents"), "doc_id", doc_tokens(), 3, 3)


@query("""WITH t AS (SELECT p_partkey, regexp_replace(replace(replace(lower(p_name || ' ' || p_brand || ' no ' || p_partkey), 'small ring', '{name}'), 'red', '{name}'), '[0-9]+', '{n}', 'g') AS k FROM part) SELECT k AS template, count(*) AS n, min(p_partkey) AS first FROM t GROUP BY k""")
def d04_templates(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    t = part.select("p_partkey", neardup.template(F.concat(F.concat_ws(" ", "p_name", "p_brand"), F.lit(" no "), F.col("p_partkey").cast("string")), ["red", "small ring"]).alias("template"))
    return t.groupBy("template").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query(r"""WITH t AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' pages' || CASE WHEN p_partkey % 2 = 0 THEN ': Design ' || p_partkey ELSE '' END), '\s*:\s*design\s+[0-9]+$', ''), '\s+pages$', '')) AS k FROM part) SELECT k AS title_key, count(*) AS n FROM t GROUP BY k HAVING count(*) > 1""")
def d11_similarity_keys(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(": Design "), F.col("p_partkey").cast("string"))).otherwise("")
    k = table(spark, sf, "part").select(neardup.similarity_key(F.concat("p_name", F.lit(" pages"), suffix), "pages").alias("title_key"))
    return k.groupBy("title_key").agg(F.count("*").alias("n")).where("n > 1")


# taxonomy -----------------------------------------------------------------------------------------------

VOCABULARY = [("subject", "fastener", "bolt", "hardware"), ("subject", "fastener", "screw", "hardware"), ("subject", "ring", "ring", None), ("subject", "gear", "gear", "hardware"), ("style", "bright", "red", None), ("style", "bright", "blue", None), ("style", "small", "small", None), ("theme", "promo", "promo", None), ("theme", "value", "economy", "promo")]
_VOC = "v(dim, term, alias, parent) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in VOCABULARY) + ")"
_SIG = f"""{_VOC}, w AS (SELECT DISTINCT p_partkey AS asset, unnest({_WORDS.format(_MATCH.format("(p_name || ' ' || p_type)"))}) AS alias FROM part), g AS (SELECT DISTINCT asset, dim, term FROM w JOIN v USING (alias) UNION SELECT asset, dim, parent FROM w JOIN v USING (alias) WHERE parent IS NOT NULL)"""
_CAND = f"""{_SIG}, c AS (SELECT dim || ':' || term AS hub, dim, term, count(DISTINCT asset) AS n FROM g GROUP BY dim, term HAVING count(DISTINCT asset) >= 10)"""


def part_signals(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = spark.createDataFrame(VOCABULARY, "dim string, term string, alias string, parent string")
    items = table(spark, sf, "part").withColumn("label", F.concat_ws(" ", "p_name", "p_type"))
    return taxonomy.signals(items, vocabulary, "p_partkey", "label")


def part_candidates(spark: SparkSession, sf: str) -> DataFrame:
    found = part_signals(spark, sf)
    c = taxonomy.candidates(found, 10)
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("asset"), "p_type")
    return taxonomy.scored(c.join(taxonomy.evidence(found, c, items, "p_type", 3), "hub"))


@query(f"WITH {_SIG} SELECT asset, dim, term FROM g")
def t01_signals(spark: SparkSession, sf: str) -> DataFrame:
    return part_signals(spark, sf)


@query(f"""WITH {_CAND}, e AS (SELECT hub, p_type, count(*) AS k, row_number() OVER (PARTITION BY hub ORDER BY count(*) DESC, p_type) AS rn FROM c JOIN g USING (dim, term) JOIN part ON p_partkey = asset GROUP BY hub, p_type), x AS (SELECT hub, count(*) AS categories, string_agg(p_type, ',' ORDER BY rn) FILTER (rn <= 3) AS top FROM e GROUP BY hub),
s AS (SELECT hub, n, categories, top, round(least(100, greatest(0, (CASE WHEN n >= 400 THEN 100 WHEN n >= 150 THEN 85 WHEN n >= 60 THEN 65 WHEN n >= 20 THEN 40 ELSE 10 END) * 0.65 + (CASE WHEN categories >= 6 THEN 100 WHEN categories >= 4 THEN 70 WHEN categories >= 2 THEN 40 ELSE 10 END) * 0.35)), 4)::DOUBLE AS score FROM c JOIN x USING (hub))
SELECT hub, n, categories, top, score, CASE WHEN score >= 85 THEN 'core' WHEN score >= 60 THEN 'phase2' WHEN score >= 35 THEN 'backlog' ELSE 'reject' END AS tier, array_to_string(list_filter([CASE WHEN n < 60 THEN 'small' END, CASE WHEN categories < 3 THEN 'narrow' END], lambda r: r IS NOT NULL), ',') AS reasons FROM s""")
def t05_scored_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return part_candidates(spark, sf).select("hub", "n", "categories", "top", "score", "tier", "reasons")


@query(f"""WITH {_CAND}, a AS (SELECT DISTINCT hub, p_type AS term FROM c JOIN g USING (dim, term) JOIN part ON p_partkey = asset) SELECT x.hub, y.hub AS other, count(*) AS shared FROM a x JOIN a y ON x.term = y.term AND x.hub <> y.hub GROUP BY 1, 2""")
def t07_related_by_terms(spark: SparkSession, sf: str) -> DataFrame:
    found = part_signals(spark, sf)
    big = table(spark, sf, "part").select(F.col("p_partkey").alias("asset"), "p_type")
    a = taxonomy.candidates(found, 10).join(found, ["dim", "term"]).join(big, "asset").select("hub", F.col("p_type").alias("term"))
    return taxonomy.related_by_terms(a)


@query(f"""WITH {_CAND}, m AS (SELECT asset, hub FROM g JOIN c USING (dim, term)) SELECT asset, count(*) AS n_hubs, string_agg(hub, ',' ORDER BY hub) AS hubs FROM m GROUP BY asset""")
def t09_item_map(spark: SparkSession, sf: str) -> DataFrame:
    found = part_signals(spark, sf)
    m = found.join(taxonomy.candidates(found, 10), ["dim", "term"]).groupBy("asset").agg(F.array_sort(F.collect_set("hub")).alias("h"))
    return m.select("asset", F.size("h").cast("bigint").alias("n_hubs"), F.array_join("h", ",").alias("hubs"))


@query()
def t12_greedy_promotion(spark: SparkSession, sf: str) -> DataFrame:
    found = overlap.both_ways(overlap.pairs(membership(spark, sf)))
    ratios = found.select("hub", "other", (F.col("common") / F.least("hub_size", "other_size")).alias("ratio"))
    sizes = membership(spark, sf).groupBy("hub").agg(F.count("*").cast("double").alias("score"))
    return taxonomy.greedy_promotion(sizes, ratios, 0.9, 12)


_GRAMS = f"""d AS (SELECT doc_id, source, {_TOK} AS l FROM documents), s AS (SELECT doc_id, source, unnest(l) AS a, unnest(range(1, len(l) + 1)) AS i FROM d), x AS (SELECT doc_id, source, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, source, a AS f, a AS e, a AS phrase, 1 AS size FROM x UNION ALL SELECT doc_id, source, a, b, a || ' ' || b, 2 FROM x WHERE b IS NOT NULL UNION ALL SELECT doc_id, source, a, c, a || ' ' || b || ' ' || c, 3 FROM x WHERE c IS NOT NULL), q AS (SELECT DISTINCT doc_id, source, phrase, size FROM p WHERE f NOT IN ('the','of','and') AND e NOT IN ('the','of','and'))"""


@query(f"""WITH {_GRAMS}, r AS (SELECT phrase, size, count(*) AS n, count(DISTINCT source) AS sources FROM q GROUP BY 1, 2 HAVING count(*) >= 10) SELECT *, CASE WHEN size = 1 AND n > 150 THEN 'generic' WHEN sources < 3 THEN 'narrow' WHEN n >= 40 THEN 'promote' WHEN n >= 15 THEN 'review' ELSE 'reject' END AS decision FROM r""")
def t13_phrase_candidates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    rolled = taxonomy.mined_phrases(docs.select("doc_id", "source", doc_tokens().alias("tokens")), "doc_id", "source", "tokens", ["the", "of", "and"], 10)
    return rolled.withColumn("decision", taxonomy.decision())


@query("""SELECT p_type AS hub, round(avg(CASE WHEN contains(lower(p_name || ' ' || p_brand), left(lower(p_type), 1)) THEN 1 ELSE 0 END), 6) AS share FROM part GROUP BY 1""")
def t24_intent_share(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    m = part.select(F.col("p_type").alias("hub"), F.col("p_partkey").alias("asset"))
    titles = part.select(F.col("p_partkey").alias("asset"), F.concat_ws(" ", "p_name", "p_brand").alias("title"))
    return taxonomy.intent_share(m, titles, F.left(F.lower("hub"), F.lit(1)))


# search and recommendation ----------------------------------------------------------------------------------


@query("""WITH q AS (SELECT DISTINCT q FROM (SELECT p_name AS q FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT string_split(p_name, ' ')[2] FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1] FROM part WHERE p_partkey % 50 = 0)),
i AS (SELECT p_partkey AS key, p_name AS title, lower(p_type) AS label, 'brand ' || replace(lower(p_brand), '#', ' ') AS terms, p_name || ' ' || lower(p_type) || ' brand ' || replace(lower(p_brand), '#', ' ') AS blob FROM part),
m AS (SELECT q AS query, key, title, CASE WHEN title = q THEN 1 WHEN title LIKE q || ' %' THEN 2 WHEN len(list_filter(string_split(q, ' '), lambda w: NOT list_contains(string_split(title, ' '), w))) = 0 THEN 3 WHEN contains(blob, q) THEN 7 END AS match_class FROM i, q)
SELECT query, key, match_class, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY match_class, length(title), title, key) AS rank FROM m WHERE match_class IS NOT NULL) WHERE rank <= 10""")
def r02_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    w = lambda i: F.get(F.split("p_name", " "), F.lit(i))
    q = part.where("p_partkey % 50 = 0").select(F.explode(F.array(F.col("p_name"), w(1), F.concat_ws(" ", w(1), w(0)))).alias("query")).distinct()
    brand = F.concat(F.lit("brand "), F.regexp_replace(F.lower("p_brand"), "#", " "))
    items = part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"), F.lower("p_type").alias("label"), brand.alias("terms"), F.concat_ws(" ", "p_name", F.lower("p_type"), brand).alias("blob"))
    return search.ranked(items, q, 10)


_FEAT = "t AS (SELECT p_partkey AS asset, w AS token, CASE WHEN w IN ('red','blue','green','small') THEN 'broad' ELSE 'strong' END AS kind FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)), m AS (SELECT p_brand AS hub, p_partkey AS asset FROM part), z AS (SELECT hub, count(*) AS size FROM m GROUP BY hub), f AS (SELECT hub, token, kind, count(DISTINCT asset) AS members FROM m JOIN t USING (asset) GROUP BY 1, 2, 3)"


def part_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("asset"), F.explode(F.split("p_name", " ")).alias("token"))
    return t.withColumn("kind", F.when(F.col("token").isin("red", "blue", "green", "small"), "broad").otherwise("strong"))


@query(f"WITH {_FEAT} SELECT * FROM f")
def a14_hub_profiles(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "part").select(F.col("p_brand").alias("hub"), F.col("p_partkey").alias("asset"))
    return search.hub_profiles(m, part_tokens(spark, sf))


@query(f"WITH {_FEAT}, s AS (SELECT asset, hub, round(sum((CASE WHEN kind = 'strong' THEN 3.0 ELSE 1.0 END)::DOUBLE * members / size), 6) AS score FROM t JOIN f USING (token, kind) JOIN z USING (hub) GROUP BY 1, 2) SELECT asset, hub, score FROM s")
def r06_hub_match_scores(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "part").select(F.col("p_brand").alias("hub"), F.col("p_partkey").alias("asset"))
    sizes = m.groupBy("hub").agg(F.count("*").alias("size"))
    tokens = part_tokens(spark, sf)
    return search.match_scores(tokens, search.hub_profiles(m, tokens), sizes)


@query("""WITH m AS (SELECT p_brand AS hub, p_partkey AS asset, p_name AS key, p_size AS score FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY hub, key ORDER BY score DESC, asset) > 1 AS again FROM m), f AS (SELECT *, count(*) FILTER (NOT again) OVER (PARTITION BY hub) AS fresh, row_number() OVER (PARTITION BY hub ORDER BY again, score DESC, asset) AS rank FROM r) SELECT hub, asset, rank FROM f WHERE rank <= 40 AND (NOT again OR fresh < 45)""")
def w09_featured(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "part").select(F.col("p_brand").alias("hub"), F.col("p_partkey").alias("asset"), F.col("p_name").alias("key"), F.col("p_size").alias("score"))
    return search.featured(m, 40, 45)


@query()
def w12_spread_pages(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = table(spark, sf, "part").withColumn("pos", F.row_number().over(order)).withColumn("page", F.concat_ws("/", "p_brand", F.ceil(F.col("pos") / 48).cast("string")))
    return search.spread(p.select("page", "pos", F.col("p_type").alias("grp"), "p_partkey"), "page", "pos", "grp")


@query()
def w13_rotation(spark: SparkSession, sf: str) -> DataFrame:
    """The featured pool of each brand, turned by the three-day window of the last event."""
    m = table(spark, sf, "part").select(F.col("p_brand").alias("hub"), F.col("p_partkey").alias("asset"), F.col("p_name").alias("key"), F.col("p_size").alias("score"))
    day = table(spark, sf, "events").agg(F.max("ts").alias("ts")).select(keys.three_day_key(F.col("ts")).alias("window"))  # one row
    return search.rotation(search.featured(m, 40, 45).join(day), "hub", "asset", keys.fnv1a(F.concat("hub", "window")), 12)


@query(f"""WITH {_PAIRS}, x AS (SELECT hub AS owner, other AS hub, row_number() OVER (PARTITION BY hub ORDER BY common DESC, other) AS rank FROM d), k(hub, cluster, preferred) AS (VALUES ('Brand#1', 'one', 'Brand#1'), ('Brand#2', 'one', 'Brand#1'), ('SMALL', 'size', 'LARGE'), ('LARGE', 'size', 'LARGE')), slots AS (SELECT owner, coalesce(cluster, 'hub:' || x.hub) AS slot, min(rank) AS r, min_by(x.hub, rank) AS first, max(preferred) AS preferred FROM x LEFT JOIN k ON x.hub = k.hub GROUP BY 1, 2)
SELECT owner, hub, rank FROM (SELECT owner, coalesce(preferred, first) AS hub, row_number() OVER (PARTITION BY owner ORDER BY r, slot) AS rank FROM slots) WHERE rank <= 6""")
def w19_cluster_dedup(spark: SparkSession, sf: str) -> DataFrame:
    near = overlap.nearest(overlap.pairs(membership(spark, sf)), 1 << 30).select(F.col("hub").alias("owner"), F.col("other").alias("hub"), "rank")
    clusters = spark.createDataFrame([("Brand#1", "one", "Brand#1"), ("Brand#2", "one", "Brand#1"), ("SMALL", "size", "LARGE"), ("LARGE", "size", "LARGE")], "hub string, cluster string, preferred string")
    return search.cluster_first(near, clusters, 6)


# ledgers and streams ------------------------------------------------------------------------------------------


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def st02_last_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.last_by_key(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def st02_streamed_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return ledgers.streamed_upserts(spark, f"{sf}/events.parquet", ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'open' WHEN l.quality = 1 THEN 'accepted' ELSE 'rejected' END AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def st03_decision_queue(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("state"))
    return ledgers.decision_queue(table(spark, sf, "documents").select("doc_id"), labels, "doc_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'frozen-' || o_custkey ELSE lower(o_orderpriority) || '-' || o_orderkey END AS route FROM orders""")
def st05_sticky_routes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    previous = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.concat(F.lit("frozen-"), F.col("o_custkey").cast("string")).alias("previous"))
    new = F.concat_ws("-", F.lower("o_orderpriority"), F.col("o_orderkey").cast("string"))
    return ledgers.sticky(o.select("o_orderkey", new.alias("route")), previous, "o_orderkey", "route")


@query("""SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.event_id = e.event_id AND (x.event_id % 3 = 0 OR x.event_type = 'error'))""")
def st01_resume(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    ledger = e.where("event_id % 3 = 0").select("event_id", F.lit("done").alias("status")).unionByName(e.where("event_type = 'error'").select("event_id", F.lit("quarantined").alias("status")))
    return ledgers.still_open(e, ledger, "event_id", resume=True).select("event_id")
