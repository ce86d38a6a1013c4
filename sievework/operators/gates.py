"""Constraints, coverage and duplicate gates: violations come back as tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
    """Q1: (code, value, n) for each value of each named key that stands more than once."""
    found = F.explode(F.array(*(F.struct(F.lit(k).alias("code"), c.cast("string").alias("value")) for k, c in keys.items())))
    return df.select(found.alias("k")).where("k.value is not null").groupBy("k.code", "k.value").agg(F.count("*").alias("n")).where("n > 1")


def violations(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """Q2, Q5, Q9: (key, code) for each rule that a row breaks; rules hold where the row is wrong."""
    codes = F.array_compact(F.array(*(F.when(bad, F.lit(code)) for code, bad in rules.items())))
    return df.select(key, F.explode(codes).alias("code"))


def dangling(refs: DataFrame, ref: str, targets: DataFrame, target: str) -> DataFrame:
    """Q3: references without a target."""
    return refs.where(F.col(ref).isNotNull()).join(targets.select(F.col(target).alias(ref)).distinct(), ref, "left_anti")


def membership_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """J15, LG6: (status, key) of what only one side holds."""
    a = expected.select(key).distinct().withColumn("_e", F.lit(True))
    b = actual.select(key).distinct().withColumn("_a", F.lit(True))
    both = a.join(b, key, "full_outer").where("_e is null or _a is null")
    return both.select(key, F.when(F.col("_a").isNull(), "missing").otherwise("unexpected").alias("status"))


def unpivoted(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field, value) rows of some columns."""
    return df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))).alias("f")).select(key, "f.field", "f.value")


def mismatches(expected: DataFrame, actual: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field, expected, actual) wherever two tables disagree on a key."""
    e, a = unpivoted(expected, key, columns), unpivoted(actual, key, columns)
    met = e.withColumnRenamed("value", "expected").join(a.withColumnRenamed("value", "actual"), [key, "field"], "left")
    return met.where(~F.col("expected").eqNullSafe(F.col("actual")))


def coverage(df: DataFrame, fields: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(field, verified, inferred, missing) in one pass; fields: name -> (is there, is verified)."""
    sums = [F.struct(F.lit(n).alias("field"), F.count_if(there & sure).alias("verified"), F.count_if(there & ~sure).alias("inferred"), F.count_if(~there).alias("missing")) for n, (there, sure) in fields.items()]
    return df.agg(F.array(*sums).alias("rows")).select(F.inline("rows"))


def budget_check(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Q14: (id, measured, limit, passed); a limit without a measurement fails."""
    return limits.join(measured, "id", "left").select("id", "measured", "limit", F.coalesce(F.col("measured") <= F.col("limit"), F.lit(False)).alias("passed"))


def all_pass(checks: DataFrame) -> DataFrame:
    """Q15: one row: do all checks pass, and which don't."""
    return checks.agg(F.bool_and("passed").alias("passed"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("id")))), ",").alias("blockers"))


def guarded(new: DataFrame, rejected: Column, most: int) -> DataFrame:
    """Q4: the rows, or none of them if more than ``most`` are rejected."""
    counted = new.agg(F.count_if(rejected).alias("_rejected"))
    return new.join(counted).where(F.col("_rejected") <= most).drop("_rejected")


def guarded_by(new: DataFrame, group: str, rejected: Column, most: float) -> DataFrame:
    """Q4: the rows of groups of which at most ``most`` rows are rejected."""
    good = new.groupBy(group).agg(F.count_if(rejected).alias("_rejected")).where(F.col("_rejected") <= most).select(group)
    return new.join(good, group, "left_semi")


def run_score(terms: Sequence[tuple[Column, float]]) -> Column:
    """Q8: 100 less what each rule that holds costs, between 0 and 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - reduce(lambda a, b: a + b, (F.when(c, F.lit(float(v))).otherwise(0.0) for c, v in terms))))


def partition_faults(parts: Mapping[str, DataFrame], key: str, whole: DataFrame) -> DataFrame:
    """(key, code) of keys in several parts, in none, or in parts but not in the whole."""
    rows = reduce(lambda a, b: a.unionByName(b), (d.select(key).distinct().withColumn("_p", F.lit(n)) for n, d in parts.items()))
    held = rows.groupBy(key).agg(F.count("*").alias("_n"))
    both = held.join(whole.select(key).distinct().withColumn("_w", F.lit(True)), key, "full_outer")
    code = F.when(F.col("_w").isNull(), "unknown").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "overlap")
    return both.select(key, code.alias("code")).where("code is not null")


def suffix_tally(titles: DataFrame, key: str, title: str, patterns: Sequence[tuple[str, str]], k: int = 3) -> DataFrame:
    """Q19: (pattern, suffix, n, examples): the variant suffixes of titles by the first named pattern that matches, ``none`` where none does.

    ``suffix`` is the match with its digits as ``#``; ``examples`` are the keys
    of the first ``k`` rows.
    """
    name, found = F.lit("none"), F.lit("")
    for code, pattern in reversed(patterns):
        hit = F.regexp_extract(F.coalesce(title, F.lit("")), pattern, 0)
        name, found = F.when(hit != "", code).otherwise(name), F.when(hit != "", hit).otherwise(found)
    rows = titles.select(F.col(key).alias("_key"), name.alias("pattern"), F.regexp_replace(found, "[0-9]+", "#").alias("suffix"))
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("pattern", "suffix").orderBy("_key")))
    return ranked.groupBy("pattern", "suffix").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_rn") <= k, F.col("_key")))).alias("examples"))
