"""Projections, predicates and tags driven by rule tables and ordered rules."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import match_text, words


def codes(rules: Mapping[str, Column]) -> Column:
    """The names of the rules that hold, in their order."""
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))


def any_term(text: Column, terms: Sequence[str]) -> Column:
    """does the text contain any of the terms, in any case?"""
    return reduce(lambda a, b: a | b, (F.lower(text).contains(t.lower()) for t in terms))


def rule_tags(items: DataFrame, rules: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tags) with the tags whose terms stand in the text; the rule table is small vocabulary and goes to every task as one row."""
    packed = rules.agg(F.array_sort(F.collect_list(F.struct("id", "terms"))).alias("_rules"))
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    held = F.filter("_rules", lambda r: F.exists(r["terms"], lambda t: F.contains(text, t)))
    return items.join(packed).select(id_col, F.transform(held, lambda r: r["id"]).alias("tags"))


def has_all(tags: Column, wanted: Sequence[str]) -> Column:
    """the conjunction of facets."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0


def first_rule(rules: Sequence[tuple[Column, Column, float]], default: Column, confidence: float, names: tuple[str, str]) -> list[Column]:
    """value and confidence of the first rule that holds."""
    value = reduce(lambda acc, r: acc.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1])).otherwise(default)
    sure = reduce(lambda acc, r: acc.when(r[0], r[2]), rules[1:], F.when(rules[0][0], rules[0][2])).otherwise(confidence)
    return [value.alias(names[0]), sure.alias(names[1])]


def first_match(c: Column, patterns: Sequence[tuple[str, str]], default: str) -> Column:
    """F16, LG3: the name of the first pattern that matches."""
    return reduce(lambda acc, p: acc.when(c.rlike(p[0]), p[1]), patterns[1:], F.when(c.rlike(patterns[0][0]), patterns[0][1])).otherwise(default)


def phrase_findings(docs: DataFrame, phrases: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, finding, times) for each phrase in each text; phrases (id, phrase) in lower case, a small table."""
    packed = phrases.agg(F.collect_list(F.struct("id", "phrase")).alias("_p"))
    low = docs.select(id_col, F.lower(text_col).alias("_t")).join(packed)
    hit = low.select(id_col, "_t", F.explode(F.filter("_p", lambda p: F.contains(F.col("_t"), p["phrase"]))).alias("p"))
    times = (F.length("_t") - F.length(F.replace(F.col("_t"), F.col("p.phrase"), F.lit("")))) / F.length("p.phrase")
    return hit.select(id_col, F.col("p.id").alias("finding"), times.cast("bigint").alias("times"))


def stuffing(docs: DataFrame, id_col: str, text_col: str, least: int, times: int) -> DataFrame:
    """(id, most, stuffed): how often the commonest longer word occurs, and how many occur more than ``times`` times.

    An id's texts meet as texts and are counted in one place; words as rows
    would be several times as much to shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, most, stuffed = [], [], []
            for i in range(batch.num_rows):
                counts = [n for w, n in Counter((batch.column(1)[i].as_py() or "").split(" ")).items() if w and len(w) >= least]
                if counts:
                    at.append(i)
                    most.append(max(counts))
                    stuffed.append(sum(n > times for n in counts))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(most, pa.int64()), pa.array(stuffed, pa.int64())], [id_col, "most", "stuffed"])

    texts = docs.groupBy(id_col).agg(F.array_join(F.collect_list(match_text(F.col(text_col))), " ").alias("text"))
    return texts.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, most bigint, stuffed bigint")


def first_hits(docs: DataFrame, id_col: str, text_col: str, needle: str, before: int, width: int) -> DataFrame:
    """(id, line_no, col, context) of the first hit in each line, in any case."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    hits = lines.withColumn("col", F.locate(needle, F.lower("line"))).where("col > 0")
    return hits.select(id_col, (F.col("line_no") + 1).alias("line_no"), "col", F.expr(f"substring(line, greatest(1, col - {before}), {width})").alias("context"))


def leaks(pages: DataFrame, id_col: str, html_col: str, checks: Sequence[tuple[str, str, bool]]) -> DataFrame:
    """(check_id, id) for each named pattern in the raw or the visible text; a page is read once."""
    visible = F.regexp_replace(F.regexp_replace(html_col, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    seen = pages.select(id_col, F.col(html_col).alias("_raw"), visible.alias("_visible"))
    held = codes({name: F.col("_visible" if v else "_raw").rlike(p) for name, p, v in checks})
    return seen.select(F.explode(held).alias("check_id"), id_col)


def sections(hubs: DataFrame, key: Column, patterns: Sequence[tuple[str, str]], default: str, order: Sequence[Column]) -> DataFrame:
    """hubs in named sections by ordered patterns, ranked inside each."""
    named = hubs.withColumn("section", first_match(key, patterns, default))
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy(*order)))


def defect_counts(docs: DataFrame, id_col: str, text_col: str, patterns: Sequence[tuple[str, str]]) -> DataFrame:
    """(defect, n, example) per named pattern, in one pass."""
    held = docs.select(id_col, F.explode(codes({name: F.col(text_col).rlike(p) for name, p in patterns})).alias("defect"))
    return held.groupBy("defect").agg(F.count("*").alias("n"), F.min(id_col).alias("example"))
