"""Queries over joins, aggregates, windows, samples, set operations and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import keys, text
from sievework.operators import gates, overlap, records, sampling
from sievework.plans.registry import query
from sievework.session import table

_M = "m AS (SELECT DISTINCT hub, asset FROM (SELECT p_type AS hub, p_name AS asset FROM part UNION ALL SELECT p_brand, p_name FROM part)), s AS (SELECT hub, count(*) AS n FROM m GROUP BY hub)"
_PAIRS = _M + """, c AS (SELECT l.hub AS "left", r.hub AS "right", count(*) AS common FROM m l JOIN m r ON l.asset = r.asset AND l.hub < r.hub GROUP BY 1, 2),
p AS (SELECT c.*, a.n AS left_size, b.n AS right_size, a.n + b.n - common AS union_size, common / (a.n + b.n - common) AS jaccard, common / a.n AS left_in_right, common / b.n AS right_in_left, common = a.n AND common = b.n AS exact FROM c JOIN s a ON a.hub = c."left" JOIN s b ON b.hub = c."right"),
d AS (SELECT "left" AS hub, "right" AS other, common, left_size AS hub_size, right_size AS other_size FROM p UNION ALL SELECT "right", "left", common, right_size, left_size FROM p)"""
_CLASS = "CASE WHEN exact THEN 'exact' WHEN jaccard >= 0.8 THEN 'near' WHEN greatest(left_in_right, right_in_left) >= 0.95 THEN 'contained' END"


def membership(spark: SparkSession, sf: str) -> DataFrame:
    """Collections of part names: every type and every brand."""
    part = table(spark, sf, "part")
    return part.select(F.col("p_type").alias("hub"), F.col("p_name").alias("asset")).unionByName(part.select(F.col("p_brand").alias("hub"), F.col("p_name").alias("asset"))).distinct()


@query(f'WITH {_PAIRS} SELECT "left", "right", common, left_size, right_size, union_size, round(jaccard, 6) AS jaccard, round(left_in_right, 6) AS left_in_right, round(right_in_left, 6) AS right_in_left, exact, {_CLASS} AS warning FROM p')
def hub_overlap_audit(spark: SparkSession, sf: str) -> DataFrame:
    found = overlap.pairs(membership(spark, sf)).withColumn("warning", overlap.warning_class())
    return found.withColumns({c: F.round(c, 6) for c in ("jaccard", "left_in_right", "right_in_left")})


@query("""WITH m AS (SELECT DISTINCT l_suppkey AS hub, l_partkey AS asset FROM lineitem), s AS (SELECT hub, count(*) AS n FROM m GROUP BY hub), c AS (SELECT l.hub AS "left", r.hub AS "right", count(*) AS common FROM m l JOIN m r ON l.asset = r.asset AND l.hub < r.hub GROUP BY 1, 2)
SELECT "left", "right", common, round(common / (a.n + b.n - common), 6) AS jaccard FROM c JOIN s a ON a.hub = "left" JOIN s b ON b.hub = "right" """)
def j05_supplier_overlap(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("hub"), F.col("l_partkey").alias("asset"))
    return overlap.pairs(m).select("left", "right", "common", F.round("jaccard", 6).alias("jaccard"))


@query(f"WITH {_PAIRS}, x AS (SELECT *, common / hub_size AS ratio, row_number() OVER (PARTITION BY hub ORDER BY common / hub_size DESC, other) AS rn FROM d WHERE other_size >= hub_size * 0.65 AND other_size <= hub_size * 1.35) SELECT hub, round(max(ratio), 6) AS max_overlap, string_agg(other, ',' ORDER BY rn) FILTER (rn <= 6) AS notes FROM x GROUP BY hub")
def j06_same_scale_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.same_scale(overlap.pairs(membership(spark, sf))).withColumn("max_overlap", F.round("max_overlap", 6))


@query(f'WITH {_PAIRS} SELECT "left", "right", common, round(common / least(left_size, right_size), 6) AS ratio FROM p WHERE common / least(left_size, right_size) >= 0.8 ORDER BY common / least(left_size, right_size) DESC, common DESC, "left", "right" LIMIT 40')
def j07_cannibal_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.cannibals(overlap.pairs(membership(spark, sf))).withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {_PAIRS}, x AS (SELECT hub, other, common, row_number() OVER (PARTITION BY hub ORDER BY common DESC, other) AS rank FROM d) SELECT * FROM x WHERE rank <= 5")
def j08_nearest_hubs(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.nearest(overlap.pairs(membership(spark, sf)), 5)


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS l FROM part), t AS (SELECT p_partkey AS asset, l[1] AS a, l[2] AS b FROM w) SELECT a AS "left", b AS "right", count(*) AS n FROM t GROUP BY 1, 2 HAVING count(*) >= 6""")
def j10_modifier_subjects(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "part").select(F.col("p_partkey").alias("asset"), F.posexplode(F.split("p_name", " ")).alias("i", "term"))
    terms = w.where("i < 2").select("term", F.when(F.col("i") == 0, "modifier").otherwise("subject").alias("class"), "asset")
    return overlap.combinations(terms, "modifier", "subject", 6)


@query(f"WITH {_PAIRS}, x AS (SELECT hub, other, row_number() OVER (PARTITION BY hub ORDER BY other_size, other) AS rn FROM d WHERE common = hub_size AND other_size > hub_size) SELECT hub, other AS parent FROM x WHERE rn = 1")
def t08_smallest_superset(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.smallest_superset(overlap.pairs(membership(spark, sf)))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, s_name, n_name, r_name, c_mktsegment FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def j01_enriched_lines(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    li = t("lineitem")
    out = li.join(t("orders"), li["l_orderkey"] == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    out = out.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name", "s_name", "n_name", "r_name", "c_mktsegment")


@query("""SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic, CASE WHEN l.doc_id IS NULL THEN 'default' ELSE 'label' END AS provenance FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def j02_label_overrides(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").withColumn("_there", F.lit(True))
    out = table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    return out.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.when(F.col("_there").isNull(), "default").otherwise("label").alias("provenance"))


@query("""SELECT 'included' AS status, count(*) AS n, min(doc_id) AS first FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'deferred', count(*), min(doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def j03_available_and_deferred(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    count = lambda d, s: d.agg(F.lit(s).alias("status"), F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return count(docs.join(labels, "doc_id", "left_semi"), "included").unionByName(count(docs.join(labels, "doc_id", "left_anti"), "deferred"))


@query(f"WITH {_M} SELECT asset, count(*) AS n_hubs, string_agg(hub, ',' ORDER BY hub) AS hubs FROM m GROUP BY asset")
def j04_reverse_bridge(spark: SparkSession, sf: str) -> DataFrame:
    g = membership(spark, sf).groupBy("asset").agg(F.array_sort(F.collect_set("hub")).alias("h"))
    return g.select("asset", F.size("h").cast("bigint").alias("n_hubs"), F.array_join("h", ",").alias("hubs"))


@query("""WITH e AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS cust, o_orderstatus AS status FROM orders), a AS (SELECT o_orderkey AS k, CAST(CASE WHEN o_orderkey % 10 = 0 THEN o_custkey + 1 ELSE o_custkey END AS VARCHAR) AS cust, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders)
SELECT e.k, 'cust' AS field, e.cust AS expected, a.cust AS actual FROM e JOIN a USING (k) WHERE e.cust IS DISTINCT FROM a.cust UNION ALL SELECT e.k, 'status', e.status, a.status FROM e JOIN a USING (k) WHERE e.status IS DISTINCT FROM a.status""")
def j14_system_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"))
    changed = o.select("k", F.when(F.col("k") % 10 == 0, F.col("cust") + 1).otherwise(F.col("cust")).alias("cust"), F.when(F.col("k") % 7 != 0, F.col("status")).alias("status"))
    return gates.mismatches(o, changed, "k", ["cust", "status"])


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'unexpected' END AS status FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def j15_membership_diff(spark: SparkSession, sf: str) -> DataFrame:
    return gates.membership_diff(table(spark, sf, "documents").where("doc_id % 3 <> 0"), table(spark, sf, "labels"), "doc_id")


@query("""WITH a AS (SELECT l_suppkey AS hub, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1), b AS (SELECT l_suppkey AS hub, count(*) AS n FROM lineitem GROUP BY 1) SELECT coalesce(a.hub, b.hub) AS hub, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS drift FROM a FULL JOIN b ON a.hub = b.hub""")
def j17_count_drift(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "hub")
    old = F.count_if(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp"))
    return li.groupBy("hub").agg(old.alias("before"), F.count("*").alias("after")).withColumn("drift", F.col("after") - F.col("before"))


@query("""SELECT p_partkey, kind, lower(p_brand) || '/' || kind || '/' || p_partkey || '.' || ext AS object_key, CASE WHEN kind = 'svg' THEN p_size * 1000 ELSE p_size * 100 END AS bytes FROM part, (VALUES ('svg', 'svg'), ('preview', 'webp')) m(kind, ext)""")
def j21_media_entries(spark: SparkSession, sf: str) -> DataFrame:
    media = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(e).alias("ext"), F.lit(b).alias("unit")) for k, e, b in (("svg", "svg", 1000), ("preview", "webp", 100)))))
    p = table(spark, sf, "part").withColumn("m", media)
    key = F.concat(F.concat_ws("/", F.lower("p_brand"), "m.kind", F.col("p_partkey").cast("string")), F.lit("."), F.col("m.ext"))
    return p.select("p_partkey", F.col("m.kind").alias("kind"), key.alias("object_key"), (F.col("p_size") * F.col("m.unit")).alias("bytes"))


# aggregates -------------------------------------------------------------------------------------------


@query("""SELECT source, lang, count(*) AS n, count(DISTINCT text) AS texts, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (n_chars > 3000) AS long, bool_or(text LIKE '%@%') AS any_mail FROM documents GROUP BY source, lang""")
def a04_source_summary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 3000).alias("long"), F.bool_or(F.col("text").contains("@")).alias("any_mail"))


@query("""WITH r AS (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars > 3000 THEN 'long' END, CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL)) AS flag FROM documents) SELECT flag, count(*) AS n FROM r GROUP BY flag""")
def a02_flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = gates.violations(table(spark, sf, "documents"), "doc_id", {"long": F.col("n_chars") > 3000, "short": F.col("n_chars") < 200, "foreign": F.col("lang") != "en"})
    return found.groupBy(F.col("code").alias("flag")).agg(F.count("*").alias("n"))


_RUNS = "r AS (SELECT l_returnflag || l_linestatus AS variant, l_partkey AS sample, p_type AS grp, l_discount < 0.08 AS ok, greatest(0, least(100, 100 - (CASE WHEN l_quantity < 5 THEN 30 ELSE 0 END) - (CASE WHEN l_extendedprice > 60000 THEN 25 ELSE 0 END) - (CASE WHEN l_tax > 0.05 THEN 10 ELSE 0 END))) AS score FROM lineitem JOIN part ON l_partkey = p_partkey)"


def runs(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    score = gates.run_score([(F.col("l_quantity") < 5, 30), (F.col("l_extendedprice") > 60000, 25), (F.col("l_tax") > 0.05, 10)])
    return li.select(F.concat("l_returnflag", "l_linestatus").alias("variant"), F.col("l_partkey").alias("sample"), F.col("p_type").alias("grp"), (F.col("l_discount") < 0.08).alias("ok"), score.alias("score"))


def by_variant(r: DataFrame, *by: str) -> DataFrame:
    """Success rate, mean score over successes, candidate rate."""
    return r.groupBy(*by, "variant").agg(F.count("*").alias("n"), F.round(F.count_if("ok") / F.count("*"), 6).alias("success"), F.round(F.avg(F.when(F.col("ok"), F.col("score"))), 6).alias("mean_score"), F.round(F.count_if(F.col("ok") & (F.col("score") >= 70)) / F.count("*"), 6).alias("candidates"))


_AGG = "count(*) AS n, round(count(*) FILTER (ok) / count(*), 6) AS success, round(avg(score) FILTER (ok), 6) AS mean_score, round(count(*) FILTER (ok AND score >= 70) / count(*), 6) AS candidates"


@query(f"WITH {_RUNS}, a AS (SELECT variant, {_AGG} FROM r GROUP BY variant) SELECT *, row_number() OVER (ORDER BY success DESC, mean_score DESC, candidates DESC, n DESC, variant) AS rank FROM a")
def a06_variant_ranking(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.orderBy(F.desc("success"), F.desc("mean_score"), F.desc("candidates"), F.desc("n"), "variant")
    return by_variant(runs(spark, sf)).withColumn("rank", F.row_number().over(order))


@query(f"""WITH {_RUNS}, o AS (SELECT variant, {_AGG} FROM r GROUP BY variant), b AS (SELECT variant FROM o ORDER BY mean_score DESC, variant LIMIT 1), g AS (SELECT grp, variant, {_AGG} FROM r GROUP BY grp, variant),
t AS (SELECT grp, variant, mean_score, row_number() OVER (PARTITION BY grp ORDER BY mean_score DESC, variant) AS rn FROM g), d AS (SELECT g.grp, g.variant, g.mean_score FROM g JOIN b USING (variant))
SELECT t.grp, CASE WHEN t.mean_score - d.mean_score >= 0.3 THEN t.variant ELSE d.variant END AS chosen, t.mean_score AS best, d.mean_score AS default_score FROM t JOIN d USING (grp) WHERE rn = 1""")
def a07_variant_policy(spark: SparkSession, sf: str) -> DataFrame:
    r = runs(spark, sf)
    best = by_variant(r).orderBy(F.desc("mean_score"), "variant").limit(1).select(F.col("variant").alias("default"))
    g = by_variant(r, "grp")
    top = sampling.top_per_group(g, ["grp"], [F.desc("mean_score"), F.asc("variant")], 1).select("grp", "variant", F.col("mean_score").alias("best"))
    usual = g.join(best, F.col("variant") == F.col("default"), "left_semi").select("grp", F.col("variant").alias("usual"), F.col("mean_score").alias("default_score"))
    chosen = F.when(F.col("best") - F.col("default_score") >= 0.3, F.col("variant")).otherwise(F.col("usual"))
    return top.join(usual, "grp").select("grp", chosen.alias("chosen"), "best", "default_score")


_PD = "list_sort(list(n_chars))[CAST(ceil(count(*) * {0}) AS INT)]"


@query(f"SELECT source, min(n_chars) AS least, {_PD.format(0.5)} AS median, {_PD.format(0.9)} AS p90, {_PD.format(0.95)} AS p95, max(n_chars) AS most FROM documents GROUP BY source")
def a09_distributions(spark: SparkSession, sf: str) -> DataFrame:
    ranks = {"median": 0.5, "p90": 0.9, "p95": 0.95}
    return table(spark, sf, "documents").groupBy("source").agg(F.min("n_chars").alias("least"), *(keys.nearest_rank("n_chars", p).alias(n) for n, p in ranks.items()), F.max("n_chars").alias("most"))


@query("""WITH w AS (SELECT p_partkey, p_type, unnest(string_split(p_name, ' ')) AS token FROM part) SELECT token, count(*) AS n, count(DISTINCT p_type) AS kinds, min(p_partkey) AS first FROM w GROUP BY token""")
def a10_token_frequency(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "part").select("p_partkey", "p_type", F.explode(F.split("p_name", " ")).alias("token"))
    return w.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("kinds"), F.min("p_partkey").alias("first"))


@query("""WITH e AS (SELECT p_brand AS hub, token, sum(w) AS weight FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS token, 2 AS w FROM part UNION ALL SELECT p_brand, lower(p_type), 1 FROM part) GROUP BY 1, 2) SELECT hub, token, CAST(weight AS BIGINT) AS weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY hub ORDER BY weight DESC, token) AS rank FROM e) WHERE rank <= 8""")
def a11_evidence_terms(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumnRenamed("p_brand", "hub")
    names = part.select("hub", F.explode(F.split("p_name", " ")).alias("token"), F.lit(2).alias("w"))
    both = names.unionByName(part.select("hub", F.lower("p_type").alias("token"), F.lit(1).alias("w")))
    return sampling.top_per_group(both.groupBy("hub", "token").agg(F.sum("w").alias("weight")), ["hub"], [F.desc("weight"), F.asc("token")], 8)


@query("""WITH h AS (SELECT p_brand AS hub, count(*) AS members FROM part GROUP BY 1), f AS (SELECT p_brand AS hub, p_type AS tag, count(*) AS n FROM part GROUP BY 1, 2), x AS (SELECT f.*, row_number() OVER (PARTITION BY hub ORDER BY n DESC, tag) AS rank FROM f JOIN h USING (hub) WHERE n >= CASE WHEN members > 80 THEN 14 WHEN members > 40 THEN 8 ELSE 2 END AND n < members) SELECT * FROM x WHERE rank <= 4""")
def a12_facets(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "part").groupBy(F.col("p_brand").alias("hub"), F.col("p_type").alias("tag")).agg(F.count("*").alias("n"))
    f = f.withColumn("members", F.sum("n").over(Window.partitionBy("hub")))
    least = F.when(F.col("members") > 80, 14).when(F.col("members") > 40, 8).otherwise(2)
    return sampling.top_per_group(f.where((F.col("n") >= least) & (F.col("n") < F.col("members"))), ["hub"], [F.desc("n"), F.asc("tag")], 4).drop("members")


@query("""SELECT p_name AS title, count(*) AS n, count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS kinds, min(p_partkey) AS first, count(DISTINCT p_brand || p_type) = 1 AS same_place FROM part GROUP BY p_name HAVING count(*) > 1""")
def a15_duplicate_titles(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "part").groupBy(F.col("p_name").alias("title"))
    return g.agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_type").alias("kinds"), F.min("p_partkey").alias("first"), (F.count_distinct(F.concat("p_brand", "p_type")) == 1).alias("same_place")).where("n > 1")


@query("""SELECT doc_id AS duplicate, canonical FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents) WHERE doc_id <> canonical""")
def a17_exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("canonical"), F.count("*").alias("n")).where("n > 1")
    return docs.join(first, "h").where("doc_id <> canonical").select(F.col("doc_id").alias("duplicate"), "canonical")


@query("""SELECT 'lang' AS field, count(*) FILTER (lang = 'en') AS verified, count(*) FILTER (lang <> 'en') AS inferred, count(*) FILTER (lang IS NULL) AS missing FROM documents UNION ALL SELECT 'long', count(*) FILTER (n_chars > 3000), count(*) FILTER (n_chars BETWEEN 500 AND 3000), count(*) FILTER (n_chars < 500) FROM documents""")
def a19_coverage(spark: SparkSession, sf: str) -> DataFrame:
    fields = {"lang": (F.col("lang").isNotNull(), F.col("lang") == "en"), "long": (F.col("n_chars") >= 500, F.col("n_chars") > 3000)}
    return gates.coverage(table(spark, sf, "documents"), fields)


@query("""SELECT lang, source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, round(avg(n_chars), 6) AS mean_bytes FROM documents GROUP BY ROLLUP (lang, source)""")
def a21_bytes_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").rollup("lang", "source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("bytes"), F.round(F.avg("n_chars"), 6).alias("mean_bytes"))


@query("""WITH f AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), p AS (SELECT n_chars FROM f WHERE i IN (SELECT CAST(floor(k * (n - 1) / 100) AS BIGINT) FROM range(101) r(k), (SELECT count(*) AS n FROM documents))) SELECT list_sort(list(n_chars))[CAST(floor(count(*) / 2) AS INT) + 1] AS median, count(*) AS picked FROM p""")
def a24_sampled_median(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    f = records.positions(docs, "doc_id", ["n_chars"]).withColumnRenamed("position", "i")
    at = docs.agg(F.count("*").alias("n")).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(100)), lambda k: F.floor(k * (F.col("n") - 1) / 100))).alias("i")).distinct()
    p = f.join(at, "i").agg(F.array_sort(F.collect_list("n_chars")).alias("l"))
    return p.select(F.get("l", F.floor(F.size("l") / 2).cast("int")).alias("median"), F.size("l").cast("bigint").alias("picked"))


@query("""WITH b AS (SELECT lang || '/' || source AS batch, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents) SELECT batch, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rn) FILTER (rn <= 3) AS samples FROM b GROUP BY batch""")
def a26_review_batches(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "documents").select(F.concat_ws("/", "lang", "source").alias("batch"), "doc_id")
    b = b.withColumn("rn", F.row_number().over(Window.partitionBy("batch").orderBy("doc_id")))
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.col("doc_id")))), ",").alias("samples"))


@query("""SELECT p_brand AS hub, count(*) AS members, count(*) FILTER (p_size > 25) AS large, min(p_name) AS first_title FROM part GROUP BY 1 HAVING count(*) < 80""")
def a30_small_hubs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("hub")).agg(F.count("*").alias("members"), F.count_if(F.col("p_size") > 25).alias("large"), F.min("p_name").alias("first_title")).where("members < 80")


@query("""SELECT count(*) FILTER (regexp_matches(text, '^The ')) AS opens_the, count(*) FILTER (regexp_matches(text, '^[A-Z]+!!')) AS opens_shout, count(*) FILTER (regexp_matches(text, '[.]$')) AS ends_stop FROM documents""")
def a31_prose_frames(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").agg(F.count_if(t.rlike("^The ")).alias("opens_the"), F.count_if(t.rlike("^[A-Z]+!!")).alias("opens_shout"), F.count_if(t.rlike(r"[.]\z")).alias("ends_stop"))


# windows, samples and order ------------------------------------------------------------------------------

_HELD = "CASE WHEN p_partkey % 3 = 0 THEN p_size % 9 END"


@query(f"""WITH r AS (SELECT p_partkey, p_name, {_HELD} AS prev, count(*) OVER (PARTITION BY p_name) AS n FROM part), h AS (SELECT *, CASE WHEN prev > 0 AND row_number() OVER (PARTITION BY p_name, prev ORDER BY p_partkey) = 1 THEN prev END AS held FROM r),
free AS (SELECT g.p_name, k, row_number() OVER (PARTITION BY g.p_name ORDER BY k) AS rn FROM (SELECT DISTINCT p_name, n FROM r) g, range(1, 1000) t(k) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.p_name = g.p_name AND held = k) AND k <= n + 20),
o AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rn FROM h WHERE held IS NULL AND n > 1)
SELECT h.p_partkey, h.p_name, CASE WHEN n > 1 THEN CAST(coalesce(held, k) AS BIGINT) END AS design_number FROM h LEFT JOIN o ON o.p_partkey = h.p_partkey LEFT JOIN free f ON f.p_name = o.p_name AND f.rn = o.rn""")
def w01_design_numbers(spark: SparkSession, sf: str) -> DataFrame:
    prev = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") % 9)
    return sampling.design_numbers(table(spark, sf, "part").withColumn("prev", prev), "p_partkey", "p_name", "prev")


@query("""WITH g AS (SELECT p_brand AS grp, count(*) AS n FROM part GROUP BY 1), s AS (SELECT grp, k, CASE WHEN k = 1 THEN 1e300 ELSE (CASE WHEN grp LIKE '%1%' THEN 2.0 ELSE 1.0 END) * sqrt(n) / k END AS score FROM g, range(1, 101) t(k) WHERE k <= n), t AS (SELECT grp FROM s ORDER BY score DESC, grp, k LIMIT 100) SELECT grp, count(*) AS seats FROM t GROUP BY grp""")
def w02_seats(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "part").groupBy(F.col("p_brand").alias("grp")).agg(F.count("*").alias("n"))
    return sampling.seats(g, "grp", "n", F.when(F.col("grp").contains("1"), 2.0).otherwise(1.0), 100)


@query("""WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('s' || p_partkey), p_partkey) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part) SELECT p_partkey, p_brand FROM r WHERE n <= 5 OR i IN (SELECT CAST(floor(k * (n - 1) / 4 + 0.5) AS BIGINT) FROM range(5) t(k))""")
def w03_even_picks(spark: SparkSession, sf: str) -> DataFrame:
    h = F.sha2(F.concat(F.lit("s"), F.col("p_partkey").cast("string")), 256)
    return sampling.even_pick(table(spark, sf, "part"), ["p_brand"], [h, F.col("p_partkey")], 5).select("p_partkey", "p_brand")


@query("SELECT p_partkey FROM part ORDER BY sha256('2024' || p_partkey), p_partkey LIMIT 50")
def w04_hashed_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.hashed_sample(table(spark, sf, "part"), F.col("p_partkey"), "2024", 50).select("p_partkey")


@query("""WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn FROM part), u AS (SELECT min(p_partkey) AS p_partkey, 'promo' AS reason, 0 AS priority FROM part WHERE p_type = 'PROMO' UNION ALL SELECT min(p_partkey), 'big', 1 FROM part WHERE p_size >= 50 UNION ALL SELECT p_partkey, CASE WHEN rn % 100 = 1 THEN 'stride' ELSE 'fill' END, CASE WHEN rn % 100 = 1 THEN 2 ELSE 3 END FROM r),
b AS (SELECT p_partkey, min(priority) AS priority, min_by(reason, priority) AS reason FROM u WHERE p_partkey IS NOT NULL GROUP BY 1) SELECT p_partkey, reason FROM b ORDER BY priority, p_partkey LIMIT 60""")
def w05_covering_sample(spark: SparkSession, sf: str) -> DataFrame:
    rules = [("promo", F.col("p_type") == "PROMO"), ("big", F.col("p_size") >= 50)]
    return sampling.covering_sample(table(spark, sf, "part"), "p_partkey", rules, 100, 60)


@query("""SELECT doc_id, source, CAST(running AS BIGINT) AS running FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 20000""")
def w07_byte_budget(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.within_budget(table(spark, sf, "documents"), "n_chars", [F.asc("doc_id")], 20000, ["source"]).select("doc_id", "source", "running")


@query("""WITH r AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS turn, min(p_partkey) OVER (PARTITION BY p_type, p_brand) AS seat FROM part), q AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY turn, seat, p_brand) AS position FROM r) SELECT p_type, p_partkey, p_brand, position FROM q WHERE position <= 40""")
def w08_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    rows = sampling.round_robin(table(spark, sf, "part"), "p_brand", [F.asc("p_partkey")], [F.col("p_partkey")], 40, ["p_type"])
    return rows.select("p_type", "p_partkey", "p_brand", "position")


@query("""WITH p AS (SELECT p_type AS hub, p_partkey, CAST(ceil(row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) / 48) AS BIGINT) AS page FROM part) SELECT hub, page, count(*) AS items, page > 1 AS has_previous, page < max(page) OVER (PARTITION BY hub) AS has_next, CASE WHEN page = 1 THEN '/' || lower(hub) ELSE '/' || lower(hub) || '/page/' || page END AS route FROM p GROUP BY hub, page""")
def w11_pagination(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("hub").orderBy("p_partkey")
    p = table(spark, sf, "part").withColumnRenamed("p_type", "hub").withColumn("page", sampling.page_of(order, 48))
    pages = p.groupBy("hub", "page").agg(F.count("*").alias("items"))
    last = F.max("page").over(Window.partitionBy("hub"))
    return pages.select("hub", "page", "items", (F.col("page") > 1).alias("has_previous"), (F.col("page") < last).alias("has_next"), keys.page_route(F.concat(F.lit("/"), F.lower("hub")), F.col("page")).alias("route"))


@query("""WITH m AS (SELECT p_brand AS hub, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS pos FROM part) SELECT hub, p_partkey, pos FROM m WHERE pos <= 12""")
def w15_representatives(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "part").select(F.col("p_brand").alias("hub"), "p_partkey", "p_size")
    return sampling.top_per_group(m, ["hub"], [F.desc("p_size"), F.asc("p_partkey")], 12).select("hub", "p_partkey", F.col("rank").alias("pos"))


@query("""SELECT p_partkey, CASE WHEN row_number() OVER (ORDER BY p_size DESC, p_partkey) <= 200 OR p_type = 'PROMO' THEN 'phase1' ELSE 'backlog' END AS tier FROM part""")
def w16_phase_caps(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_type")
    kept = sampling.capped(part, "p_partkey", [F.desc("p_size"), F.asc("p_partkey")], 200, F.col("p_type") == "PROMO")
    return kept.select("p_partkey", F.when(F.col("kept"), "phase1").otherwise("backlog").alias("tier"))


@query(r"""WITH k AS (SELECT p_partkey, replace(p_name, ' ', '-') || '-' || lower(p_type) AS k FROM part) SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY k) > 1 THEN k || '-' || p_partkey ELSE k END AS object_key FROM k""")
def w17_key_collisions(spark: SparkSession, sf: str) -> DataFrame:
    k = table(spark, sf, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_type")).alias("k"))
    return k.select("p_partkey", sampling.distinct_keys(k, "k", F.col("p_partkey").cast("string")).alias("object_key"))


@query("""WITH r AS (SELECT p_partkey, p_type, p_retailprice, p_size >= 50 AS seeded, row_number() OVER (PARTITION BY p_type, p_size >= 50 ORDER BY p_retailprice DESC, p_partkey) AS rk FROM part) SELECT p_partkey, p_type FROM r WHERE seeded OR rk <= 15 ORDER BY seeded DESC, p_retailprice DESC, p_partkey LIMIT 100""")
def w18_kind_caps(spark: SparkSession, sf: str) -> DataFrame:
    rows = sampling.kind_caps(table(spark, sf, "part"), "p_type", [F.desc("p_retailprice"), F.asc("p_partkey")], 15, 100, F.col("p_size") >= 50)
    return rows.select("p_partkey", "p_type")


@query("""SELECT l_suppkey, l_partkey, n, rank FROM (SELECT l_suppkey, l_partkey, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) AS rank FROM lineitem GROUP BY 1, 2) WHERE rank <= 5""")
def o02_top_parts(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return sampling.top_per_group(n, ["l_suppkey"], [F.desc("n"), F.asc("l_partkey")], 5)


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'intersection', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'difference', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def o04_set_operations(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    sides = li.groupBy("l_partkey").agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    counts = {"union": F.col("a") | F.col("r"), "intersection": F.col("a") & F.col("r"), "difference": F.col("a") & ~F.col("r")}
    rows = F.array(*(F.struct(F.lit(op).alias("op"), F.count_if(c).alias("n")) for op, c in counts.items()))
    return sides.agg(rows.alias("rows")).select(F.inline("rows"))


@query("""SELECT user_id, event_type, event_id AS first_event FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def o08_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    first = F.min(F.struct("ts", "event_id"))["event_id"]
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(first.alias("first_event"))


# gates ------------------------------------------------------------------------------------------------------


@query("""SELECT 'name' AS code, p_name AS value, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1 UNION ALL SELECT 'key', CAST(p_partkey AS VARCHAR), count(*) FROM part GROUP BY p_partkey HAVING count(*) > 1 UNION ALL SELECT 'name+brand', p_name || '|' || p_brand, count(*) FROM part GROUP BY p_name, p_brand HAVING count(*) > 1""")
def q01_uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    return gates.duplicates(table(spark, sf, "part"), {"name": F.col("p_name"), "key": F.col("p_partkey"), "name+brand": F.concat_ws("|", "p_name", "p_brand")})


@query("""SELECT o_orderkey, 'price' AS code FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_orderkey, 'urgent-open' FROM orders WHERE o_orderpriority LIKE '1-%' AND o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'future' FROM orders WHERE o_orderdate > TIMESTAMP '2001-06-01'""")
def q02_row_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"price": F.col("o_totalprice") > 400000, "urgent-open": F.col("o_orderpriority").startswith("1-") & (F.col("o_orderstatus") == "O"), "future": F.col("o_orderdate") > F.lit("2001-06-01").cast("timestamp")}
    return gates.violations(table(spark, sf, "orders"), "o_orderkey", rules)


@query("""SELECT doc_id, label FROM (SELECT doc_id, 'label' AS label FROM labels UNION ALL SELECT doc_id + 7, 'shifted' FROM labels) r WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = r.doc_id)""")
def q03_dangling_references(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels")
    refs = labels.select("doc_id", F.lit("label").alias("label")).unionByName(labels.select((F.col("doc_id") + 7).alias("doc_id"), F.lit("shifted").alias("label")))
    return gates.dangling(refs, "doc_id", table(spark, sf, "documents"), "doc_id")


@query("""SELECT doc_id, CASE WHEN blocks > 0 THEN 'blocked' WHEN warns > 0 THEN 'warned' ELSE 'approved' END AS status, blocks, warns FROM (SELECT doc_id, CAST((n_chars < 50)::INT + (text LIKE '%!!%')::INT AS BIGINT) AS blocks, CAST((n_chars > 5000)::INT + (lang <> 'en')::INT AS BIGINT) AS warns FROM documents)""")
def q05_source_classes(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    count = lambda *c: F.size(F.array_compact(F.array(*(F.when(x, 1) for x in c)))).cast("bigint")
    d = d.select("doc_id", count(F.col("n_chars") < 50, F.col("text").contains("!!")).alias("blocks"), count(F.col("n_chars") > 5000, F.col("lang") != "en").alias("warns"))
    return d.select("doc_id", F.when(F.col("blocks") > 0, "blocked").when(F.col("warns") > 0, "warned").otherwise("approved").alias("status"), "blocks", "warns")


@query("""WITH p AS (SELECT doc_id, 'a' AS p FROM documents WHERE n_chars > 1000 UNION ALL SELECT doc_id, 'b' FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id + 3, 'c' FROM documents WHERE lang = 'de'), h AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1) SELECT coalesce(h.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'unknown' WHEN h.doc_id IS NULL THEN 'missing' ELSE 'overlap' END AS code FROM h FULL JOIN documents d ON h.doc_id = d.doc_id WHERE d.doc_id IS NULL OR h.doc_id IS NULL OR n > 1""")
def q07_partition_faults(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return gates.partition_faults({"a": d.where("n_chars > 1000"), "b": d.where("lang = 'fr'"), "c": d.where("lang = 'de'").select((F.col("doc_id") + 3).alias("doc_id"))}, "doc_id", d)


@query(f"WITH {_RUNS} SELECT variant, CAST(score AS DOUBLE) AS score, count(*) AS n FROM r GROUP BY 1, 2")
def q08_run_scores(spark: SparkSession, sf: str) -> DataFrame:
    return runs(spark, sf).groupBy("variant", "score").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT 'src:' || source AS id, CAST(sum(n_chars) AS DOUBLE) AS measured FROM documents GROUP BY 1), l AS (SELECT DISTINCT 'src:' || source AS id, 150000.0::DOUBLE AS "limit" FROM documents UNION ALL SELECT 'src:none', 1.0::DOUBLE), b AS (SELECT l.id, m.measured, l."limit", coalesce(m.measured <= l."limit", false) AS passed FROM l LEFT JOIN m USING (id)) SELECT bool_and(passed) AS passed, string_agg(id, ',' ORDER BY id) FILTER (NOT passed) AS blockers FROM b""")
def q14_budget_gate(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("id", F.concat(F.lit("src:"), "source"))
    measured = d.groupBy("id").agg(F.sum("n_chars").cast("double").alias("measured"))
    limits = d.select("id").distinct().withColumn("limit", F.lit(150000.0)).unionByName(spark.createDataFrame([("src:none", 1.0)], "id string, limit double"))
    return gates.all_pass(gates.budget_check(measured, limits))


@query(r"""SELECT regexp_extract(url, '[?#].*$') AS suffix, count(*) AS n FROM pages GROUP BY 1""")
def q19_suffix_tally(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").groupBy(F.regexp_extract("url", "[?#].*$", 0).alias("suffix")).agg(F.count("*").alias("n"))
