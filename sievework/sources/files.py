"""Readers and writers: manifests, crawls, sitemaps, inventories, exports.

All of them go through Spark's readers and writers, so a path may lie in any
store that the session can reach.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.operators.tagging import codes
from sievework.sources import pages


def read_manifest(spark: SparkSession, path: str, record: T.StructType, field: str = "records") -> DataFrame:
    """IO1: the records of JSON manifests (an envelope with an array), with an explicit schema."""
    schema = T.StructType([T.StructField("runId", T.StringType()), T.StructField(field, T.ArrayType(record))])
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select("runId", F.explode(field).alias("r")).select("runId", "r.*")


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """IO2: a Parquet table, or an empty one of that schema where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def crawled_routes(rows: DataFrame) -> DataFrame:
    """IO3: (route, html) of (file, html) rows: a folder's index is the folder, files under ``_next`` have no route.

    The root's ``404.html`` and ``_not-found.html`` are the route ``/404``.
    Where two files share a route, one called ``404.html`` wins, else the first
    name.  Names are compared without their texts, which are joined last.
    """
    file = F.col("file")
    stem = F.regexp_replace(file, r"\.html$", "")
    route = F.when(file == "index.html", "/").when(file.isin("404.html", "_not-found.html"), "/404").when(~file.startswith("_next/"), F.concat(F.lit("/"), F.regexp_replace(stem, "/index$", "")))
    named = rows.where(file.endswith(".html")).select(route.alias("route"), "file").where("route is not null")
    first = F.struct(F.when(F.lower(F.substring_index("file", "/", -1)) == "404.html", 0).otherwise(1), "file")
    chosen = named.groupBy("route").agg(F.min_by("file", first).alias("file"))
    return chosen.join(rows.select("file", "html"), "file").select("route", "html")


def read_crawl(spark: SparkSession, path: str, own: bool = False) -> DataFrame:
    """IO3: (route, html) of a folder of HTML files, by Spark's text reader (which has no row for an empty file) or (``own``) by the source ``html_folder``."""
    if own:
        pages.register(spark)
        return crawled_routes(spark.read.format("html_folder").option("path", path).load())
    read = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.html")
    root = path.rstrip("/").rsplit("/", 1)[-1]
    # input_file_name gives an encoded address
    file = F.regexp_replace(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), rf"^.*?/{root}/", "")
    return crawled_routes(read.select(file.alias("file"), F.col("value").alias("html")))


def write_crawl(rows: DataFrame, path: str, mode: str = "append") -> None:
    """IO3: (file, html) rows as one HTML file each."""
    pages.register(rows.sparkSession)
    rows.select("file", "html").write.format("html_folder").option("path", path).mode(mode).save()


def sitemap_rows(xml: DataFrame, col: str) -> DataFrame:
    """IO4: (page, image) rows of sitemap XML; a page without images has one row with a null."""
    urls = xml.select(F.explode(F.regexp_extract_all(col, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))).alias("u"))
    clean = lambda c: F.replace(F.replace(c, F.lit("&amp;"), F.lit("&")), F.lit("&#39;"), F.lit("'"))
    return urls.select(clean(F.regexp_extract("u", r"<loc>(.*?)</loc>", 1)).alias("page"), F.explode_outer(F.regexp_extract_all("u", F.lit(r"<image:loc>(.*?)</image:loc>"), F.lit(1))).alias("image")).withColumn("image", clean(F.col("image")))


def read_lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """IO5: (file, line) of the files under a folder that match a pattern; a file of any length is split by bytes, a line stays whole."""
    read = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter=glob)
    return read.select(F.input_file_name().alias("file"), F.col("value").alias("line"))


def read_texts(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """IO5: (file, text) of the files under a folder that match a pattern."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """IO6: (file, category, kind, bytes, modified) of a folder; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    return f.select(F.element_at(parts, -1).alias("file"), F.element_at(parts, -2).alias("category"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("kind"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def guard(path: str, root: str) -> str:
    """IO8: the path, if it lies below ``root`` and is not root itself; ValueError otherwise."""
    clean = path.rstrip("/")
    if not clean.startswith(root.rstrip("/") + "/") or ".." in clean.split("/"):
        raise ValueError(f"{path} is not below {root}")
    return clean


def replace_tree(df: DataFrame, path: str, root: str, by: Sequence[str] = ()) -> None:
    """IO8: overwrite an output tree; only the partitions that ``df`` holds where it is partitioned."""
    out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if by else "static")
    (out.partitionBy(*by) if by else out).parquet(guard(path, root))


def export_scopes(items: DataFrame, scope: str, path: str) -> None:
    """IO7: one folder of JSON per scope; rows of a scope stay lines, so no scope is built up in memory."""
    items.repartition(F.col(scope), F.pmod(F.xxhash64(*[c for c in items.columns if c != scope]), F.lit(8))).write.mode("overwrite").partitionBy(scope).json(path)


def export_csv(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """IO9: a quoted CSV report of fixed columns; each part has a header of its own, an empty table one part with nothing else."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def sitemap_entries(routes: DataFrame, col: str) -> DataFrame:
    """IO10."""
    root = F.col(col) == "/"
    return routes.select(F.col(col).alias("path"), F.when(root, "weekly").otherwise("monthly").alias("changefreq"), F.when(root, 1.0).when(F.col(col).rlike("^/[^/]*/?$"), 0.8).otherwise(0.6).alias("priority"))


def image_entries(items: DataFrame, routes: DataFrame) -> DataFrame:
    """IO11: (item, page, image, errors); items: (item, page, image), routes: (page, indexable)."""
    met = items.join(routes, "page", "left")
    bad = codes({"no-route": F.col("indexable").isNull(), "not-indexable": ~F.coalesce("indexable", F.lit(True)), "no-image": F.coalesce("image", F.lit("")) == "", "relative-image": ~F.coalesce("image", F.lit("http")).rlike("^https?://")})
    return met.select("item", "page", "image", F.array_join(bad, ",").alias("errors"))


def json_ld(kind: str, **fields: Column) -> Column:
    """IO12: a structured-data object as JSON; null and empty fields are left out."""
    parts = [F.lit(kind).alias("@type"), *(F.when(c.cast("string") != "", c).alias(k) for k, c in fields.items())]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "true"})
