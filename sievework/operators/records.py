"""Published records: enrichment, attributes, review routing, availability and digests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import cut


def scoped(df: DataFrame, kinds: Sequence[str], kind: str, key: str, start: int, n: int) -> DataFrame:
    """rows of some kinds, ``n`` of them from position ``start`` in key order."""
    rows = df.where(F.col(kind).isin(*kinds)).orderBy(key).offset(start).limit(n)
    return rows


def attributes(items: DataFrame, membership: DataFrame, policy: DataFrame) -> DataFrame:
    """(asset, field, values, provenance): attribute values by the policy (hub, field, value), ``verified`` where a hub says so, else ``missing``."""
    given = membership.join(policy, "hub").groupBy("asset", "field").agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias("values"))
    every = items.select("asset").join(policy.select("field").distinct())
    return every.join(given, ["asset", "field"], "left").withColumn("provenance", F.when(F.col("values").isNull(), "missing").otherwise("verified")).withColumn("values", F.coalesce("values", F.lit("")))


def reclassified(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, before, after) of rows whose status changed; both sides (key, status)."""
    met = old.withColumnRenamed("status", "before").join(new.withColumnRenamed("status", "after"), key, "full_outer")
    return met.where(~F.col("before").eqNullSafe(F.col("after"))).select(key, "before", "after")


def overlay(rows: DataFrame, editorial: DataFrame, key: str, column: str) -> DataFrame:
    """An editorial value over the row's own, with where it came from."""
    met = rows.join(editorial.withColumnRenamed(column, "_new"), key, "left")
    return met.select(key, F.coalesce("_new", column).alias(column), F.when(F.col("_new").isNotNull(), "editorial").otherwise("own").alias("origin"))


def publish_split(rows: DataFrame, key: str, ready: Column, reasons: DataFrame) -> DataFrame:
    """(key, state, reason): included rows, and deferred ones with the reason that (key, reason) gives, else ``unspecified``."""
    met = rows.select(key, ready.alias("_ready")).join(reasons, key, "left")
    return met.select(key, F.when(F.col("_ready"), "included").otherwise("deferred").alias("state"), F.when(~F.col("_ready"), F.coalesce("reason", F.lit("unspecified"))).alias("reason"))


def stage_counts(stages: Mapping[str, DataFrame], by: str) -> DataFrame:
    """A5: per group one column of counts for each stage table."""
    rows = reduce(lambda a, b: a.unionByName(b), (d.select(by, F.lit(n).alias("_stage")) for n, d in stages.items()))
    return rows.groupBy(by).agg(*(F.count_if(F.col("_stage") == n).alias(n) for n in stages))


def count_snapshots(membership: DataFrame, stored: DataFrame) -> DataFrame:
    """A3: (hub, actual, stored, matches): distinct members are the authority over stored counts."""
    actual = membership.groupBy("hub").agg(F.count_distinct("asset").alias("actual"))
    return actual.join(stored, "hub", "full_outer").select("hub", F.coalesce("actual", F.lit(0)).alias("actual"), "stored", F.coalesce(F.col("actual") == F.col("stored"), F.lit(False)).alias("matches"))


def section_tables(rows: DataFrame, dims: Sequence[str], hub: str, k: int, least: int) -> DataFrame:
    """(hub, dim, term, n, rank): the ``k`` commonest terms of each dimension with ``least`` members; dimensions with one term are dropped."""
    long = rows.select(hub, F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("term")) for d in dims))).alias("d")).select(hub, "d.*")
    n = long.where("term is not null").groupBy(hub, "dim", "term").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy(hub, "dim")
    return n.withColumn("terms", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), "term"))).where((F.col("terms") > 1) & (F.col("rank") <= k)).drop("terms")


def identical_lists(rows: DataFrame, key: str, items: Column) -> DataFrame:
    """(list_hash, n, first): groups of rows with one and the same list."""
    return rows.select(key, F.sha2(F.array_join(items, ","), 256).alias("list_hash")).groupBy("list_hash").agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def directory_counts(paths: DataFrame, col: str) -> DataFrame:
    """(dir, files, dirs): immediate files and folders of each folder."""
    parts = F.filter(F.split(col, "/"), lambda p: p != "")
    p = paths.select(parts.alias("p")).where(F.size("p") > 0)
    n = F.size("p")
    steps = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.lit("/"), F.array_join(F.slice("p", F.lit(1), i - 1), "/")).alias("dir"), F.get("p", i - 1).alias("name"), (i == n).alias("is_file")))
    rows = p.select(F.explode(steps).alias("s")).select("s.*").distinct()
    return rows.groupBy("dir").agg(F.count_if("is_file").alias("files"), F.count_if(~F.col("is_file")).alias("dirs"))


def positions(rows: DataFrame, key: str, others: Sequence[str] = ()) -> DataFrame:
    """(key, others, position): the reverse index of a sorted table, numbered part by part so that no task sees it all."""
    parts = rows.select(key, *others).repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id())
    inside = cut(parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(key))))  # range borders are drawn once
    sizes = inside.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return inside.join(F.broadcast(before), "_p").select(key, *others, (F.col("_before") + F.col("_i") - 1).alias("position"))  # one row per partition


def labelled_groups(rows: DataFrame, key: str, codes: Column, cap: int) -> DataFrame:
    """(code, n, examples) of rows by each of their codes, ``other`` where they have none."""
    held = F.when(F.size(codes) > 0, codes).otherwise(F.array(F.lit("other")))
    x = rows.select(key, F.explode(held).alias("code"))
    x = x.withColumn("_rn", F.row_number().over(Window.partitionBy("code").orderBy(key)))
    return x.groupBy("code").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_rn") <= cap, F.col(key)))), ",").alias("examples"))


def protected_digest(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row: a digest of chosen columns alone, from 256 sums over the rows' hashes, so that no list grows with the table."""
    line = F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in (key, *columns))), 256)
    part = lambda a, n: F.conv(F.substring("l", a, n), 16, 10).cast("bigint")
    sums = df.select(line.alias("l")).groupBy(F.substring("l", 1, 2).alias("b")).agg(F.sum(part(3, 10)).alias("s"), F.count("*").alias("n"))
    listed = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", F.col("s").cast("string"), F.col("n").cast("string")))), "\n")
    return sums.agg(F.sha2(listed, 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def against_baseline(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """Q17: (name, digest, approved, matches): digests by name against approved ones; both sides (name, digest)."""
    met = now.join(baseline.withColumnRenamed("digest", "approved"), "name", "full_outer")
    return met.select("name", "digest", "approved", F.col("digest").eqNullSafe(F.col("approved")).alias("matches"))


def warning_budget(groups: DataFrame, order: Sequence[Column], warned: str, budget: int) -> DataFrame:
    """How many warned rows each group may take, groups in order, ``budget`` in all."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(warned).over(w), F.lit(0))
    return groups.withColumn("allowed", F.greatest(F.lit(0), F.least(F.col(warned), F.lit(budget) - used)).cast("bigint"))


def available(tables: Mapping[str, DataFrame], keep: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of unavailable items."""
    ids = keep.select(key).distinct()
    return {name: t.join(ids, key, "left_semi") for name, t in tables.items()}


def without_run(rows: DataFrame, key: str, run: str, column: str, gone: DataFrame) -> DataFrame:
    """(key, column): rows of a former run removed, and its ids out of the others' lists, which keep their order; gone: (id)."""
    left = rows.where(F.col("run") != run).select(key, column)
    each = left.select(key, F.posexplode(column).alias("_at", "id")).join(gone.select("id").distinct(), "id", "left_anti")
    kept = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "id"))), lambda x: x["id"]).alias("_kept"))
    empty = F.slice(column, 1, 0)
    return left.join(kept, key, "left").select(key, F.coalesce("_kept", empty).alias(column))


def apply_promotions(hubs: DataFrame, promoted: DataFrame, cap: int) -> DataFrame:
    """(hub, related): related lists in both directions with a cap; promoted: (hub, related)."""
    both = promoted.select("hub", "related").unionByName(promoted.select(F.col("related").alias("hub"), F.col("hub").alias("related"))).distinct()
    ranked = both.withColumn("_rn", F.row_number().over(Window.partitionBy("hub").orderBy("related"))).where(F.col("_rn") <= cap)
    new = ranked.groupBy("hub").agg(F.array_sort(F.collect_list("related")).alias("_new"))
    return hubs.join(new, "hub", "left").select("hub", F.slice(F.array_distinct(F.concat("related", F.coalesce("_new", F.array().cast("array<string>")))), 1, cap).alias("related"))


def related_quality(related: DataFrame, targets: DataFrame, shares: Column) -> DataFrame:
    """One row: related rows, how many share context, how many point nowhere; related: (asset, other, …)."""
    met = related.join(targets.select(F.col("asset").alias("other"), F.lit(True).alias("_there")), "other", "left")
    return met.agg(F.count("*").alias("n"), F.count_if(shares).alias("shared"), F.count_if(F.col("_there").isNull()).alias("invalid"))


def concept_counts(docs: DataFrame, key: str, text: str, concepts: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """(concept, n, first): rows whose text matches a concept's pattern and, for compound rules, its second one."""
    held = F.array_compact(F.array(*(F.when(F.col(text).rlike(a) & (F.col(text).rlike(b) if b else F.lit(True)), F.lit(name)) for name, (a, b) in concepts.items())))
    return docs.select(key, F.explode(held).alias("concept")).groupBy("concept").agg(F.count("*").alias("n"), F.min(key).alias("first"))


def route_plan(hubs: DataFrame, hub: str, parent: str, root: str) -> DataFrame:
    """(hub, route, depth) of a two-level plan; the root has the shortest route."""
    return hubs.select(hub, F.when(F.col(hub) == root, "/").when(F.col(parent) == root, F.concat(F.lit("/"), F.lower(hub))).otherwise(F.concat(F.lit("/"), F.lower(parent), F.lit("/"), F.lower(hub))).alias("route"), F.when(F.col(hub) == root, 0).when(F.col(parent) == root, 1).otherwise(2).alias("depth"))


def one_per_hub(rows: DataFrame, hub: str, key: str, flagged: Column, most: int) -> DataFrame:
    """(key, reason): each hub's first row, then flagged rows, then the others, in key order, ``most`` in all."""
    first = F.row_number().over(Window.partitionBy(hub).orderBy(key)) == 1
    rank = F.when(first, 0).when(flagged, 1).otherwise(2)
    ranked = rows.select(key, rank.alias("_rank"))
    return ranked.orderBy("_rank", key).limit(most).select(key, F.when(F.col("_rank") == 0, "hub").when(F.col("_rank") == 1, "flagged").otherwise("fill").alias("reason"))


def pagination_findings(shown: DataFrame, expected: DataFrame) -> DataFrame:
    """LG13: (hub, finding): page numbers that are missing or too many, and pages whose members differ from the expected ones; both sides (hub, page, item)."""
    s = shown.groupBy("hub", "page").agg(F.count("*").alias("n"), F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias("h"))
    e = expected.groupBy("hub", "page").agg(F.count("*").alias("n"), F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias("h"))
    met = e.join(s.withColumnsRenamed({"n": "sn", "h": "sh"}), ["hub", "page"], "full_outer")
    finding = F.when(F.col("n").isNull(), "extra-page").when(F.col("sn").isNull(), "missing-page").when((F.col("n") != F.col("sn")) | (F.col("h") != F.col("sh")), "members-differ")
    return met.select("hub", "page", finding.alias("finding")).where("finding is not null")


def image_map_findings(rows: DataFrame, most: int) -> DataFrame:
    """Q23: (page, finding) of image sitemap rows (page, image): several images, none, repeated images, bad addresses."""
    shared = F.count("*").over(Window.partitionBy("image"))
    r = rows.withColumn("_shared", F.when(F.col("image").isNotNull(), shared).otherwise(0))
    g = r.groupBy("page").agg(F.count("image").alias("images"), F.max("_shared").alias("shared"), F.bool_or(~F.col("image").rlike("^https://")).alias("bad"))
    codes = F.array_compact(F.array(F.when(F.col("images") == 0, "no-image"), F.when(F.col("images") > most, "many-images"), F.when(F.col("shared") > 1, "shared-image"), F.when(F.col("bad"), "not-https")))
    return g.select("page", F.explode(codes).alias("finding"))
