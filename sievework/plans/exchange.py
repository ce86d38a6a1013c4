"""Queries that write and read exchange formats, or build their rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.plans.registry import query
from sievework.session import shared_dir, table
from sievework.sources import files

_ROUTE = r"regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', '')"


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""WITH p AS (SELECT page_id AS k, coalesce(html, '') AS html FROM pages), f AS (
SELECT CASE k % 4 WHEN 0 THEN '/a/' || k WHEN 1 THEN '/b/' || k WHEN 2 THEN '/c/x y/' || k ELSE '/d/' || k || '/404' END AS route, html FROM p UNION ALL SELECT '/404', 'not found')
SELECT route, length(html) AS n, md5(html) AS digest FROM f""")
def io03_crawl(spark: SparkSession, sf: str) -> DataFrame:
    """The pages written as files (plain names, index files, names with spaces, not-found pages beside another file of their route) and crawled."""
    at = f"{fresh(spark, 'crawl')}/out"
    k = F.col("page_id").cast("string")
    own = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("a/"), k, F.lit(".html"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("b/"), k, F.lit("/index.html"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("c/x y/"), k, F.lit(".html"))).otherwise(F.concat(F.lit("d/"), k, F.lit("/404.html")))
    rows = table(spark, sf, "pages").select("page_id", own.alias("file"), F.coalesce("html", F.lit("")).alias("html"))
    files.write_crawl(rows, at)
    beside = rows.where("page_id % 4 = 3").select(F.concat(F.lit("d/"), F.col("page_id").cast("string"), F.lit("/404/index.html")).alias("file"), F.lit("another").alias("html"))
    roots = spark.createDataFrame([("404.html", "not found"), ("_not-found.html", "other"), ("_next/x.html", "no route")], "file string, html string")
    files.write_crawl(beside.unionByName(roots), at)
    found = files.read_crawl(spark, at, own=True)
    return found.select("route", F.length("html").cast("bigint").alias("n"), F.md5("html").alias("digest"))


@query("SELECT DISTINCT url AS page, CASE WHEN page_id % 2 = 0 THEN url || '/x.png' END AS image FROM pages")
def io04_sitemap_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sitemap XML made of the pages, parsed back."""
    url = F.replace("url", F.lit("&"), F.lit("&amp;"))
    one = F.concat(F.lit("<url><loc>"), url, F.lit("</loc>"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<image:image><image:loc>"), url, F.lit("/x.png</image:loc></image:image>"))).otherwise(""), F.lit("</url>"))
    xml = table(spark, sf, "pages").select(F.concat(F.lit("<urlset>"), one, F.lit("</urlset>")).alias("xml"))
    return files.sitemap_rows(xml, "xml").distinct()


@query("SELECT p_type AS scope, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part GROUP BY 1")
def io07_scoped_export(spark: SparkSession, sf: str) -> DataFrame:
    at = fresh(spark, "scopes")
    files.export_scopes(table(spark, sf, "part").select(F.col("p_type").alias("scope"), "p_partkey", "p_name"), "scope", at)
    read = spark.read.schema("p_partkey bigint, p_name string, scope string").json(at)
    return read.groupBy("scope").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


@query("SELECT doc_id, text FROM documents")
def io09_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    at = fresh(spark, "csv")
    files.export_csv(table(spark, sf, "documents"), ["doc_id", "text"], at)
    return spark.read.schema("doc_id bigint, text string").option("header", True).option("multiLine", True).option("escape", '"').csv(at)


@query(rf"""WITH r AS (SELECT DISTINCT {_ROUTE} AS path FROM pages) SELECT path, CASE WHEN path = '/' THEN 'weekly' ELSE 'monthly' END AS changefreq, CASE WHEN path = '/' THEN 1.0 WHEN regexp_matches(path, '^/[^/]*/?$') THEN 0.8 ELSE 0.6 END::DOUBLE AS priority FROM r""")
def io10_sitemap_entries(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", "").alias("route")).distinct()
    return files.sitemap_entries(p, "route")


@query("""WITH i AS (SELECT p_partkey AS item, p_type AS page, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN '/rel/' || p_partkey ELSE 'https://img.example/' || p_partkey END AS image FROM part), r AS (SELECT DISTINCT p_type AS page, p_type <> 'SMALL' AS indexable FROM part WHERE p_type <> 'LARGE')
SELECT item, i.page, image, array_to_string(list_filter([CASE WHEN indexable IS NULL THEN 'no-route' END, CASE WHEN NOT coalesce(indexable, true) THEN 'not-indexable' END, CASE WHEN image = '' THEN 'no-image' END, CASE WHEN NOT regexp_matches(image, '^https?://') THEN 'relative-image' END], lambda x: x IS NOT NULL), ',') AS errors FROM i LEFT JOIN r ON i.page = r.page""")
def io11_image_entries(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    image = F.when(F.col("p_partkey") % 7 == 0, "").when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("/rel/"), key)).otherwise(F.concat(F.lit("https://img.example/"), key))
    part = table(spark, sf, "part")
    routes = part.where("p_type <> 'LARGE'").select(F.col("p_type").alias("page"), (F.col("p_type") != "SMALL").alias("indexable")).distinct()
    return files.image_entries(part.select(F.col("p_partkey").alias("item"), F.col("p_type").alias("page"), image.alias("image")), routes)


@query("""SELECT p_partkey, '{"@type":"Product","name":"' || p_name || '"' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ',"brand":"' || p_brand || '"' END || ',"size":' || p_size || '}' AS json FROM part""")
def io12_structured_data(spark: SparkSession, sf: str) -> DataFrame:
    brand = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", files.json_ld("Product", name=F.col("p_name"), brand=brand, size=F.col("p_size")).alias("json"))


@query("SELECT 'run-' || p_brand AS \"runId\", p_partkey, p_name FROM part")
def io01_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """Manifests of up to 4,096 ids of one brand, written as one JSON envelope each and read back."""
    at = fresh(spark, "manifests")
    p = table(spark, sf, "part").withColumn("bucket", F.floor(F.col("p_partkey") / 4096))
    one = p.groupBy("p_brand", "bucket").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))).alias("records"))
    line = F.to_json(F.struct(F.concat(F.lit("run-"), "p_brand").alias("runId"), "records"))
    one.select(line.alias("value"), F.regexp_replace("p_brand", "#", "-").alias("brand"), "bucket").repartition("brand", "bucket").write.partitionBy("brand", "bucket").text(at)
    record = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType())])
    return files.read_manifest(spark, f"{at}/*/*", record)


@query("SELECT 'written' AS name, count(*) AS n FROM region UNION ALL SELECT 'absent', 0")
def io02_optional_tables(spark: SparkSession, sf: str) -> DataFrame:
    at, region = fresh(spark, "optional"), table(spark, sf, "region")
    region.write.parquet(f"{at}/written")
    rows = [files.read_optional(spark, f"{at}/{n}", region.schema).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("written", "absent")]
    return rows[0].unionByName(rows[1])


@query("SELECT doc_id, length(text) AS n FROM documents")
def io05_scanned_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as JSON lines and read back line by line."""
    at = fresh(spark, "texts")
    table(spark, sf, "documents").select("doc_id", "text").write.json(at)
    lines = files.read_lines(spark, at, "*.json").where("line <> ''")
    return lines.select(F.from_json("line", "doc_id bigint, text string").alias("d")).select("d.doc_id", F.length("d.text").cast("bigint").alias("n"))


@query("SELECT DISTINCT 'scope=' || p_type AS category, 'json' AS kind, true AS filled FROM part")
def io06_inventory(spark: SparkSession, sf: str) -> DataFrame:
    at = fresh(spark, "inventory")
    files.export_scopes(table(spark, sf, "part").select(F.col("p_type").alias("scope"), "p_partkey", "p_name"), "scope", at)
    return files.inventory(spark, at).where("file like 'part-%'").groupBy("category", "kind").agg((F.sum("bytes") > 0).alias("filled"))


@query("SELECT p_type, count(*) AS n, CAST(sum(CASE WHEN p_type = 'SMALL' THEN p_size + 100 ELSE p_size END) AS BIGINT) AS sizes FROM part GROUP BY 1")
def io08_replaced_tree(spark: SparkSession, sf: str) -> DataFrame:
    """A partitioned tree of which one partition is replaced."""
    root = fresh(spark, "tree")
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_type")
    files.replace_tree(p, f"{root}/out", root, ["p_type"])
    files.replace_tree(p.where("p_type = 'SMALL'").withColumn("p_size", F.col("p_size") + 100), f"{root}/out", root, ["p_type"])
    return spark.read.schema(p.schema).parquet(f"{root}/out").groupBy("p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))
