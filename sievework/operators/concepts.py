"""Concept evidence by one automaton over whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sievework.session import cut


def _blocks(terms: DataFrame, block_chars: int) -> Iterator[list[str]]:
    """The distinct terms in blocks of about ``block_chars`` characters."""
    own = terms.select(F.col("term").cast("string").alias("term")).where("term <> ''").distinct()
    n = -(-(own.agg(F.sum(F.length("term") + 1)).first()[0] or 0) // block_chars)
    for b in range(n):
        if block := [r.term for r in own.where(F.pmod(F.xxhash64("term"), F.lit(n)) == b).collect()]:
            yield block


def term_places(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str, edges: str | None = None, around: int = 20, block_chars: int = 4_000_000) -> DataFrame:
    """(id, term, start, context): every place of every term in every text, overlapping ones too.

    One pass finds the terms of a block at once, in time that does not depend
    on how many there are (Aho-Corasick); ``block_chars`` bounds what is
    broadcast, and further blocks read the texts again.  With ``edges`` a hit
    counts only between characters of that string or the ends of the text;
    ``around`` characters on both sides are the context.  ``start`` counts code
    points from zero.  Null texts and null or empty terms give nothing; terms
    are matched as they are.
    """
    kind = docs.schema[id_col].dataType
    schema = f"id {kind.simpleString()}, term string, start int, context string"
    read = docs.select(F.col(id_col), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    found = []
    for block in _blocks(terms, block_chars):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick  # on the executors alone

            automaton = ahocorasick.Automaton()
            for term in sent.value:
                automaton.add_word(term, term)
            automaton.make_automaton()
            fine = None if edges is None else set(edges)
            for batch in batches:
                rows, hits, held = [], [], 0
                for row, text in enumerate(batch.column(1)):
                    text = text.as_py()
                    for last, term in automaton.iter(text):
                        start, past = last + 1 - len(term), last + 1
                        if fine is not None and not ((start == 0 or text[start - 1] in fine) and (past == len(text) or text[past] in fine)):
                            continue
                        rows.append(row)
                        hits.append((term, start, text[max(0, start - around) : past + around]))
                    held += len(text)
                    if held > 4 << 20 or len(rows) > 50_000:
                        yield _rows(batch, rows, hits)
                        rows, hits, held = [], [], 0
                yield _rows(batch, rows, hits)

        def _rows(batch: pa.RecordBatch, rows: list[int], hits: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([h[k] for h in hits], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))]
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())).cast(to_arrow_type(kind)), *columns], ["id", "term", "start", "context"])

        found.append(read.mapInArrow(run, schema))
    return reduce(lambda a, b: a.unionByName(b), found) if found else docs.sparkSession.createDataFrame([], schema)


def concept_evidence(docs: DataFrame, concepts: DataFrame, id_col: str, text_col: str, least: int, examples: int = 8, edges: str | None = None) -> DataFrame:
    """(concept, hits, rows, terms, supported, examples): how often a concept's terms stand in the texts and where first.

    ``concepts``: (concept, term); a term may speak for several concepts.
    ``supported`` asks for ``least`` rows; ``examples`` are the concept's first
    rows, each with its first place and context.  Concepts without hits stay,
    with zeros.
    """
    kinds = concepts.select("concept", F.col("term").cast("string").alias("term")).where("concept is not null").distinct()
    hits = cut(term_places(docs, kinds.where("term is not null"), id_col, text_col, edges))
    # one row for each text and concept before groups grow
    by_row = hits.join(kinds, "term").groupBy("concept", "id").agg(F.count("*").alias("n"), F.collect_set("term").alias("terms"), F.min(F.struct("start", "term", "context")).alias("first"))
    by_row = cut(by_row)
    sums = by_row.groupBy("concept").agg(F.sum("n").alias("hits"), F.count("*").alias("rows"))
    used = by_row.select("concept", F.explode("terms").alias("term")).groupBy("concept").agg(F.count_distinct("term").alias("terms"))
    first = by_row.select("concept", F.struct("id", "first.start", "first.term", "first.context").alias("x"))
    ranked = first.withColumn("_at", F.row_number().over(Window.partitionBy("concept").orderBy("x"))).where(F.col("_at") <= examples)
    top = ranked.groupBy("concept").agg(F.array_sort(F.collect_list("x")).alias("examples"))
    every = kinds.select("concept").distinct()
    met = every.join(sums, "concept", "left").join(used, "concept", "left").join(top, "concept", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return met.select("concept", zero("hits"), zero("rows"), zero("terms"), (F.coalesce("rows", F.lit(0)) >= least).alias("supported"), "examples")

