"""LG17: digests of tables as trees over ranges of keys, compared by descending where they differ."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import cut

#: Hex digits of a range's name that one level adds.
STEP = 1


def _number(hexed: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(hexed, at, n), 16, 10).cast("bigint")


def tree(rows: DataFrame, key: Sequence[str], columns: Sequence[str], depth: int = 4) -> DataFrame:
    """(level, range, n, a, b): for each level 0 .. depth the rows and two sums of row hashes of each range of keys.

    A range is the first ``level`` hex digits of the key's MD5.  Sums don't
    depend on order, and a range's are those of its parts: the rows are read
    once and only the leaves (16**depth at most) are added up to the levels
    above.  Repeated rows count as often as they stand; nulls differ from
    empty strings.
    """
    text = lambda cs: F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in cs))
    line = F.md5(text([*key, *columns]).cast("binary"))
    leaf = rows.select(F.substring(F.md5(text(key).cast("binary")), 1, depth * STEP).alias("range"), line.alias("line"))
    leaves = leaf.groupBy("range").agg(F.count("*").alias("n"), F.sum(_number(F.col("line"), 1, 12).cast("decimal(38,0)")).alias("a"), F.sum(_number(F.col("line"), 13, 12).cast("decimal(38,0)")).alias("b"))
    each = leaves.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"), "range", "n", "a", "b")
    part = F.expr(f"substring(range, 1, level * {STEP})")
    return each.groupBy("level", part.alias("range")).agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def digest(top: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(…, n, digest) of the roots of trees."""
    line = F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256)
    return top.where("level = 0").select(*by, "n", line.alias("digest"))


def table_digests(tables: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str]]]) -> DataFrame:
    """(name, n, digest) of several tables (rows, key, other columns); an empty table has no root and gives zero rows and an empty digest."""
    spark = next(iter(tables.values()))[0].sparkSession
    roots = [digest(tree(*t, depth=0).withColumn("name", F.lit(name)), ["name"]) for name, t in tables.items()]
    found = reduce(lambda a, b: a.unionByName(b), roots)
    names = spark.createDataFrame([(n,) for n in tables], "name string")
    return names.join(found, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("digest", F.lit("")).alias("digest"))


def changed_ranges(before: DataFrame, after: DataFrame, depth: int = 4) -> DataFrame:
    """(range, n_before, n_after): leaf ranges in which two trees differ; a level's ranges are compared only below ranges that differ."""
    a, b = cut(before), cut(after)
    open_ = None
    for level in range(depth + 1):
        x, y = (t.where(F.col("level") == level).drop("level") for t in (a, b))
        if open_ is not None:
            above = open_.select(F.col("range").alias("_above"))
            x, y = (t.join(above, F.expr(f"substring(range, 1, {(level - 1) * STEP})") == F.col("_above"), "left_semi") for t in (x, y))
        y = y.select("range", *(F.col(c).alias(f"_{c}") for c in ("n", "a", "b")))
        met = x.join(y, "range", "full_outer")
        differ = met.where(~(F.col("n").eqNullSafe(F.col("_n")) & F.col("a").eqNullSafe(F.col("_a")) & F.col("b").eqNullSafe(F.col("_b"))))
        open_ = cut(differ.select("range", F.coalesce("n", F.lit(0)).alias("n_before"), F.coalesce("_n", F.lit(0)).alias("n_after")))
        if open_.isEmpty():
            break
    return open_ if level == depth else open_.limit(0)
