"""Deterministic allocation, sampling, capping and ordering without loops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.records import positions


def seats(groups: DataFrame, key: str, size: str, weight: Column, target: int) -> DataFrame:
    """(key, seats): one seat for each group, the others by ``weight x sqrt(size) / k``, ties to the smaller key.

    Priorities fall with k inside a group, so handing seats out one by one is
    the top ``target`` of all (group, k).
    """
    rows = groups.where(F.col(size) > 0).withColumn("_k", F.explode(F.sequence(F.lit(1), F.least(F.col(size), F.lit(target)).cast("int"))))
    score = F.when(F.col("_k") == 1, F.lit(float("inf"))).otherwise(weight * F.sqrt(F.col(size).cast("double")) / F.col("_k"))
    kept = rows.withColumn("_score", score).orderBy(F.desc("_score"), key, "_k").limit(target)
    return kept.groupBy(key).agg(F.count("*").alias("seats"))


def even_pick(df: DataFrame, by: Sequence[str], order: Sequence[Column], m: int) -> DataFrame:
    """Of each group ``m`` rows at even distances of its order, first and last included."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    at = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / F.lit(max(1, m - 1)) + 0.5))
    return ranked.where((F.col("_n") <= m) | F.array_contains(at, F.col("_i").cast("bigint"))).drop("_i", "_n")


def hashed_sample(df: DataFrame, key: Column, salt: str, k: int) -> DataFrame:
    """The ``k`` rows of smallest salted hash."""
    return df.orderBy(F.sha2(F.concat(F.lit(salt), key.cast("string")), 256), key).limit(k)


def covering_sample(df: DataFrame, key: str, rules: Sequence[tuple[str, Column]], stride: int, k: int) -> DataFrame:
    """First row of each rule, then every ``stride``-th row, then others, in key order, until there are ``k``."""
    firsts = [df.where(c).agg(F.min(key).alias(key)).withColumn("reason", F.lit(name)).withColumn("priority", F.lit(i)) for i, (name, c) in enumerate(rules)]
    struck = F.col("position") % stride == 0
    every = positions(df, key).select(key, F.when(struck, "stride").otherwise("fill").alias("reason"), F.when(struck, len(rules)).otherwise(len(rules) + 1).alias("priority"))
    rows = every
    for f in firsts:
        rows = rows.unionByName(f.where(F.col(key).isNotNull()))
    best = rows.groupBy(key).agg(F.min(F.struct("priority", "reason")).alias("b")).select(key, "b.reason", "b.priority")
    return best.orderBy("priority", key).limit(k).select(key, "reason")


def within_budget(df: DataFrame, size: str, order: Sequence[Column], most: int, by: Sequence[str] = ()) -> DataFrame:
    """The prefix of each group's order whose running size stays within ``most``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= most)


def round_robin(df: DataFrame, bucket: str, order: Sequence[Column], first_seen: Sequence[Column], n: int, by: Sequence[str] = ()) -> DataFrame:
    """Buckets take turns; equals a cursor over the buckets in the order in which they first appear."""
    inside = Window.partitionBy(*by, bucket)
    rows = df.withColumn("turn", F.row_number().over(inside.orderBy(*order)))
    rows = rows.withColumn("seat", F.min(F.struct(*first_seen)).over(inside))
    out = Window.partitionBy(*by).orderBy("turn", "seat", bucket)
    return rows.withColumn("position", F.row_number().over(out)).where(F.col("position") <= n).drop("seat")


def page_of(order: Window, page_size: int) -> Column:
    """The page of a row in its list."""
    return F.ceil(F.row_number().over(order) / F.lit(page_size)).cast("bigint")


def capped(df: DataFrame, key: str, order: Sequence[Column], cap: int, protected: Column) -> DataFrame:
    """``df`` with ``kept``: is the row within the cap, or protected?  The first ``cap`` are found by a top-k and met by key."""
    first = df.orderBy(*order).limit(cap).select(key).withColumn("_first", F.lit(True))
    return df.join(first, key, "left").withColumn("kept", F.col("_first").isNotNull() | protected).drop("_first")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` of each group with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def kind_caps(df: DataFrame, kind: str, order: Sequence[Column], per_kind: int, total: int, seeded: Column) -> DataFrame:
    """Seeded rows first, then at most ``per_kind`` of each kind, at most ``total`` in all."""
    rows = df.withColumn("_seeded", seeded)
    rows = rows.withColumn("_rk", F.row_number().over(Window.partitionBy(kind, "_seeded").orderBy(*order))).where(F.col("_seeded") | (F.col("_rk") <= per_kind))
    return rows.orderBy(F.desc("_seeded"), *order).limit(total).drop("_rk", "_seeded")


def distinct_keys(df: DataFrame, key: str, ident: Column) -> Column:
    """The key, with the row's identity appended wherever the key is held by several rows."""
    return F.when(F.count("*").over(Window.partitionBy(key)) > 1, F.concat_ws("-", F.col(key), ident)).otherwise(F.col(key))


def merged_lists(a: Column, b: Column, n: int) -> Column:
    """Preferred, then fallback ids, first appearance wins, at most ``n``."""
    return F.slice(F.array_distinct(F.concat(a, b)), 1, n)


def design_numbers(items: DataFrame, key: str, group: str, previous: str) -> DataFrame:
    """Numbers in groups of equal titles: previous ones stay if they are the group's first claim on a positive number, the others take the smallest free ones in key order; single rows get none."""
    w = Window.partitionBy(group)
    rows = items.select(key, group, previous).withColumn("n", F.count("*").over(w))
    claim = Window.partitionBy(group, previous).orderBy(key)
    rows = rows.withColumn("held", F.when((F.col(previous) > 0) & (F.row_number().over(claim) == 1), F.col(previous).cast("bigint")))
    several = rows.where("n > 1")
    # the k-th free number is k plus how many held numbers lie below it
    open_ = several.where("held is null").withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(key)))
    held = several.where("held is not null").withColumn("below", F.col("held") - F.row_number().over(Window.partitionBy(group).orderBy("held")))
    both = open_.select(group, F.col(key), F.col("k").alias("v"), F.lit(0).alias("is_held")).unionByName(held.select(group, F.lit(None).cast(items.schema[key].dataType).alias(key), F.col("below").alias("v"), F.lit(1).alias("is_held")))
    skipped = F.sum("is_held").over(Window.partitionBy(group).orderBy("v", "is_held").rowsBetween(Window.unboundedPreceding, 0))
    given = both.withColumn("skipped", skipped).where("is_held = 0").select(key, (F.col("v") + F.col("skipped")).alias("design_number"))
    kept = several.where("held is not null").select(key, F.col("held").alias("design_number"))
    return rows.select(key, group).join(given.unionByName(kept), key, "left")
