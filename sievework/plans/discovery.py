"""Queries over related collections and items: brands, types and nouns of the part names are the collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import discovery, search
from sievework.plans.mining import part_tokens
from sievework.plans.registry import query
from sievework.session import table

_NOUN = "string_split(p_name, ' ')[2]"
_KIND = "CASE WHEN {0} IN ('red', 'blue', 'green', 'small') THEN 'broad' ELSE 'strong' END"
_DISC = f"""m AS (SELECT p_brand AS hub, p_partkey AS asset FROM part UNION SELECT p_type, p_partkey FROM part UNION SELECT 'w:' || {_NOUN}, p_partkey FROM part WHERE p_partkey % 2 = 0),
own AS (SELECT p_partkey AS asset, p_brand AS hub FROM part UNION SELECT p_partkey, p_type FROM part), z AS (SELECT hub, count(*) AS size FROM m GROUP BY 1),
tok AS (SELECT asset, token, {_KIND.format('token')} AS kind FROM (SELECT p_partkey AS asset, unnest(string_split(p_name, ' ')) AS token FROM part)),
ti AS (SELECT hub, token, {_KIND.format('token')} AS kind FROM (SELECT DISTINCT p_type AS hub, lower(p_type) AS token FROM part UNION SELECT DISTINCT 'w:' || {_NOUN}, {_NOUN} FROM part WHERE p_partkey % 2 = 0)),
ov AS (SELECT asset, hub, count(*) FILTER (tok.kind = 'strong') AS strong, count(*) FILTER (tok.kind = 'broad') AS broad FROM tok JOIN ti USING (token, kind) GROUP BY 1, 2),
pr AS (SELECT hub, token, kind, count(DISTINCT asset) AS members FROM m JOIN tok USING (asset) GROUP BY 1, 2, 3),
st AS (SELECT asset, hub, coalesce(sum(members) FILTER (kind = 'strong'), 0) AS s_members, count(*) FILTER (kind = 'strong') AS s_tokens, coalesce(sum(members) FILTER (kind = 'broad'), 0) AS b_members FROM tok JOIN pr USING (token, kind) GROUP BY 1, 2),
nd AS (SELECT asset, least(2, count(*) FILTER (kind = 'strong')) AS need FROM tok GROUP BY 1),
ev0 AS (SELECT coalesce(ov.asset, st.asset) AS asset, coalesce(ov.hub, st.hub) AS hub, coalesce(strong, 0) AS strong, coalesce(broad, 0) AS broad, coalesce(s_members, 0) AS s_members, coalesce(s_tokens, 0) AS s_tokens, coalesce(b_members, 0) AS b_members FROM ov FULL JOIN st ON ov.asset = st.asset AND ov.hub = st.hub),
ev AS (SELECT ev0.*, need > 0 AND s_members >= 2 AND s_tokens >= need AS balanced, strong > 0 OR (need > 0 AND s_members >= 2 AND s_tokens >= need) AS evidence FROM ev0 JOIN nd USING (asset)),
rel AS (SELECT DISTINCT p_brand AS prim, 'Brand#' || (CAST(substr(p_brand, 7) AS INT) % 25 + 1) AS hub, 'related' AS relation FROM part UNION SELECT DISTINCT p_brand, 'PROMO', 'target' FROM part UNION SELECT DISTINCT p_brand, 'w:ring', 'family' FROM part),
c0 AS (SELECT asset, hub, 'direct' AS f FROM own UNION ALL SELECT asset, hub, 'found' FROM ev WHERE evidence UNION ALL SELECT p_partkey, rel.hub, relation FROM part JOIN rel ON prim = p_brand),
c1 AS (SELECT asset, hub, bool_or(f = 'direct') AS direct, bool_or(f = 'related') AS related, bool_or(f = 'target') AS target, bool_or(f = 'family') AS family FROM c0 GROUP BY 1, 2),
sh AS (SELECT b.hub AS prim, o.hub, count(*) AS common FROM m b JOIN m o ON b.asset = o.asset AND b.hub <> o.hub WHERE b.hub LIKE 'Brand%' GROUP BY 1, 2),
c2 AS (SELECT c1.*, size, coalesce(strong, 0) AS strong, coalesce(broad, 0) AS broad, coalesce(s_members, 0) AS s_members, coalesce(b_members, 0) AS b_members, coalesce(balanced, false) AS balanced, coalesce(evidence, false) AS evidence, coalesce(common, 0) AS common FROM c1 JOIN part ON p_partkey = c1.asset JOIN z ON z.hub = c1.hub LEFT JOIN ev ON ev.asset = c1.asset AND ev.hub = c1.hub LEFT JOIN sh ON sh.prim = p_brand AND sh.hub = c1.hub WHERE c1.hub <> p_brand),
c3 AS (SELECT asset, hub, size, CAST(CASE WHEN direct THEN 10000000 ELSE 0 END + strong * 1200000 + CASE WHEN balanced THEN 200000 ELSE 0 END + least(s_members, 12) * 5000 + floor(least(1.0, s_members / size) * 5000000 + 0.5) + least(b_members, 12) * 1000 + CASE WHEN related THEN 100000 ELSE 0 END + CASE WHEN target THEN 50000 ELSE 0 END + CASE WHEN family AND common > 0 THEN 25000 ELSE 0 END + broad * 5000 + least(common, 100) * 100 AS BIGINT) AS score
FROM c2 WHERE (direct OR related OR target OR (family AND common > 0) OR evidence) AND (size > 60 OR direct))"""


def parts_of(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    p = table(spark, sf, "part")
    noun = F.get(F.split("p_name", " "), F.lit(1))
    asset = F.col("p_partkey").alias("asset")
    own = p.select(asset, F.col("p_brand").alias("hub")).unionByName(p.select(asset, F.col("p_type").alias("hub")))
    even = p.where("p_partkey % 2 = 0")
    m = own.unionByName(even.select(asset, F.concat(F.lit("w:"), noun).alias("hub"))).select("hub", "asset")
    tokens = part_tokens(spark, sf)
    kind = F.when(F.col("token").isin("red", "blue", "green", "small"), "broad").otherwise("strong").alias("kind")
    titles = p.select(F.col("p_type").alias("hub"), F.lower("p_type").alias("token")).unionByName(even.select(F.concat(F.lit("w:"), noun).alias("hub"), noun.alias("token"))).distinct().select("hub", "token", kind)
    brands = p.select(F.col("p_brand").alias("primary")).distinct()
    after = F.concat(F.lit("Brand#"), (F.substring("primary", 7, 9).cast("int") % 25 + 1).cast("string"))
    row = lambda hub, r: brands.select("primary", hub.alias("hub"), F.lit(r).alias("relation"))
    relations = row(after, "related").unionByName(row(F.lit("PROMO"), "target")).unionByName(row(F.lit("w:ring"), "family"))
    shared = m.where("hub like 'Brand%'").withColumnRenamed("hub", "primary").join(m, "asset").where("primary <> hub").groupBy("primary", "hub").agg(F.count("*").alias("common"))
    return {
        "items": p.select(asset, F.col("p_brand").alias("primary")), "own": own, "tokens": tokens, "sizes": m.groupBy("hub").agg(F.count("*").alias("size")), "titles": titles, "profiles": search.hub_profiles(m, tokens),
        "relations": relations, "shared": shared, "clusters": spark.createDataFrame([("w:ring", "round", "w:ring"), ("w:bolt", "round", "w:ring"), ("SMALL", "size", "LARGE"), ("LARGE", "size", "LARGE")], "hub string, cluster string, preferred string"),
    }


@query(f"WITH {_DISC} SELECT * FROM ov")
def r05_token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    d = parts_of(spark, sf)
    return discovery.token_overlap(d["tokens"], d["titles"])


@query(f"WITH {_DISC} SELECT asset, hub, CAST(s_members AS BIGINT) AS s_members, s_tokens, CAST(b_members AS BIGINT) AS b_members FROM st")
def r06_inventory_match(spark: SparkSession, sf: str) -> DataFrame:
    d = parts_of(spark, sf)
    return discovery.inventory_match(d["tokens"], d["profiles"])


@query(f"""WITH {_DISC}, k(hub, cluster, preferred) AS (VALUES ('w:ring', 'round', 'w:ring'), ('w:bolt', 'round', 'w:ring'), ('SMALL', 'size', 'LARGE'), ('LARGE', 'size', 'LARGE')), r AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY score DESC, hub) AS rank FROM c3),
s AS (SELECT asset, coalesce(cluster, 'hub:' || r.hub) AS slot, min(rank) AS rk, min_by(r.hub, rank) AS first, max(preferred) AS preferred FROM r LEFT JOIN k ON r.hub = k.hub GROUP BY 1, 2),
p AS (SELECT s.asset, coalesce(preferred, first) AS hub, row_number() OVER (PARTITION BY s.asset ORDER BY rk, slot) AS place FROM s), q AS (SELECT p.*, coalesce(c3.score, 0) AS score, z.size <= 60 AS small FROM p LEFT JOIN c3 ON c3.asset = p.asset AND c3.hub = p.hub LEFT JOIN z ON z.hub = p.hub),
t AS (SELECT *, count(*) FILTER (small) OVER (PARTITION BY asset ORDER BY place) AS before FROM q), u AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY place) AS rank FROM t WHERE NOT coalesce(small, false) OR before <= 1)
SELECT asset, hub, score, rank FROM u WHERE rank <= 6""")
def r07_related_hubs(spark: SparkSession, sf: str) -> DataFrame:
    return discovery.related_hubs(**parts_of(spark, sf), thin=60, thin_most=1, k=6)


_ITEMS8 = """i AS (SELECT p_partkey AS asset, p_name AS title, p_brand AS prim, [p_brand, p_type] AS hubs, CASE WHEN p_brand = 'Brand#1' THEN ['Brand#2', 'PROMO'] ELSE ['Brand#1'] END AS related, list_filter(string_split(p_name, ' '), lambda w: w NOT IN ('red', 'blue', 'green', 'small')) AS strong,
list_filter(string_split(p_name, ' '), lambda w: w IN ('red', 'blue', 'green', 'small')) AS broad, [string_split(p_name, ' ')[2]] AS subjects, list_filter(string_split(p_name, ' '), lambda w: w IN ('hot', 'cold', 'old', 'new')) AS styles, CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN [p_type] ELSE [] END AS seasons, contains(p_name, 'gear') AS pattern, CASE WHEN p_type = 'LARGE' THEN 'landscape' ELSE 'portrait' END AS orientation FROM part)"""


@query(f"""WITH {_ITEMS8}, p AS (SELECT a, b, len(list_intersect(a.strong, b.strong)) AS st, least(2, len(a.strong)) AS need FROM i a, i b WHERE a.asset <> b.asset AND len(list_intersect(list_concat(a.hubs, a.related), b.hubs)) > 0),
s AS (SELECT a.asset AS asset, b.asset AS other, b.title AS title, CAST(len(list_intersect(a.subjects, b.subjects)) * 2500000 + len(list_intersect(list_filter(a.hubs, lambda h: h <> a.prim), b.hubs)) * 300000 + st * CASE WHEN need > 0 AND st >= need THEN 900000 ELSE 700000 END + CASE WHEN need > 0 AND st >= need THEN 250000 ELSE 0 END + len(list_intersect(a.styles, b.styles)) * 350000 + len(list_intersect(a.seasons, b.seasons)) * 300000
+ CASE WHEN a.pattern AND b.pattern THEN 200000 ELSE 0 END + CASE WHEN list_contains(b.hubs, a.prim) THEN 75000 ELSE 0 END + CASE WHEN list_contains(b.hubs, a.related[1]) THEN len(a.related) * 10000 ELSE 0 END + CASE WHEN len(a.related) > 1 AND list_contains(b.hubs, a.related[2]) THEN 10000 ELSE 0 END + len(list_intersect(a.broad, b.broad)) * 10000 + CASE WHEN a.orientation = b.orientation THEN 500 ELSE 0 END AS BIGINT) AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY asset, title ORDER BY score DESC, abs(asset - other), other) > 1 AS again FROM s)
SELECT asset, other, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY again, score DESC, abs(asset - other), other) AS rank FROM r) WHERE rank <= 12""")
def r08_related_items(spark: SparkSession, sf: str) -> DataFrame:
    p, w = table(spark, sf, "part"), F.split("p_name", " ")
    only = lambda words: F.filter(w, lambda x: x.isin(*words))
    broad, strings = ["red", "blue", "green", "small"], F.array().cast("array<string>")
    items = p.select(
        F.col("p_partkey").alias("asset"), F.col("p_name").alias("title"), F.col("p_brand").alias("primary"), F.array("p_brand", "p_type").alias("hubs"), F.when(F.col("p_brand") == "Brand#1", F.array(F.lit("Brand#2"), F.lit("PROMO"))).otherwise(F.array(F.lit("Brand#1"))).alias("related"),
        F.filter(w, lambda x: ~x.isin(*broad)).alias("strong"), only(broad).alias("broad"), F.array(F.get(w, F.lit(1))).alias("subjects"), only(["hot", "cold", "old", "new"]).alias("styles"), F.when(F.col("p_type").isin("PROMO", "ECONOMY"), F.array("p_type")).otherwise(strings).alias("seasons"),
        F.contains("p_name", F.lit("gear")).alias("pattern"), F.when(F.col("p_type") == "LARGE", "landscape").otherwise("portrait").alias("orientation"),
    )
    return discovery.related_items(items, 12)
