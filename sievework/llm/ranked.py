"""Ranked lexical search: posting lists under range-maximum tables, best-first document intervals.

1. Index pass.  Each task cuts its documents into segments and writes a row for
   each: ids, lengths, and the posting lists (document, count) of the terms
   that the items use.  The rows also hold what the scores need of the corpus:
   documents with terms, terms with repeats, and document frequencies.
2. The corpus' counts are summed; one number a term goes to the driver, which
   holds the block's terms already.
3. Search pass.  A posting's impact is its share of the score.  Each list has a
   sparse table, so the greatest impact in a range of documents is found from
   two overlapping power-of-two ranges.  An item begins with the interval of
   all documents.  Of the open intervals the one with the highest bound (the
   sum of its lists' greatest impacts) is taken; at the document of its
   greatest impact it is split, that document is scored and the two rests get
   bounds of their own.  Rests of ``LEAF`` postings or fewer are scored whole.
   The item ends when no bound can still enter its best ``k``; what a task has
   found in one segment holds for its next ones.
4. The best ``k`` of each task meet in a ranking by item.

Items come in blocks of ``block_terms`` terms, the bound of what is broadcast;
each block reads the documents once.  No posting is dropped: an interval goes
only if its bound, which no document in it exceeds, is below the k-th score, or
equals it and all its ids come later.

Defined results: null and empty texts have no terms and are neither counted nor
found; an item without terms has no rows; a term counts once in an item; each
row of ``docs`` is a document of its own, null ids after all others; rows of
``items`` that agree in id and text are one item.  Terms are told apart by 64
bits of hash.  Ids of any type with an order will do.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sievework.llm._words import mix, slices, span_hashes
from sievework.session import cut

#: A term's characters: letters and digits of ASCII and everything beyond it.
GAP = np.ones(256, dtype=bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
SEGMENT = 400_000  # postings
LEAF = 1024


def term_hashes(part) -> np.ndarray:
    return mix(span_hashes(part.data, part.starts, part.ends) + (part.ends - part.starts).astype(np.uint64), 5)


def weight(n: int, df: int) -> int:
    """The weight of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """What a posting of each document gives a term of weight one."""
    m = 10 + (90 * length * n) // max(1, total)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Postings:
    """A segment's posting lists, in one array by (term, document), under one sparse table."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_docs: int):
        self.n_docs, self.impact, self.doc = n_docs, impact, doc
        self.key = term * n_docs + doc  # ascending
        self.tables = [np.arange(len(doc), dtype=np.int32)]
        longest = int(np.bincount(term).max()) if len(term) else 0
        while 2 << (len(self.tables) - 1) <= longest:
            half, have = 1 << (len(self.tables) - 1), self.tables[-1]
            a, b = have[:-half], have[half:]
            self.tables.append(np.where(impact[b] > impact[a], b, a))

    def top(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the greatest impact of each range a <= i < b stands, the first of equal ones; no range is empty."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=np.int32)
        for k in np.unique(level).tolist():
            at = level == k
            left, right = self.tables[k][a[at]], self.tables[k][b[at] - (1 << k)]
            out[at] = np.where(self.impact[right] > self.impact[left], right, left)
        return out


def best_first(lists: Postings, terms: np.ndarray, weights: np.ndarray, ids: list, found: list, k: int) -> list:
    """The best ``k`` of ``found`` and the segment's documents: (-score, id is null, id) in order."""

    def bounds(lo: int, hi: int, a: np.ndarray, b: np.ndarray, own: np.ndarray) -> tuple | None:
        full = a < b
        a, b, own = a[full], b[full], own[full]
        if not len(own):
            return None
        at = lists.top(a, b)
        share = lists.impact[at] * weights[own]
        return (-int(share.sum()), lo, hi, a, b, own, int(at[int(np.argmax(share))]))

    def give(entry: tuple) -> None:
        if len(found) < k:
            found.append(entry)
        elif entry < found[-1]:
            found[-1] = entry
        else:
            return
        found.sort()

    a, b = np.searchsorted(lists.key, terms * lists.n_docs), np.searchsorted(lists.key, (terms + 1) * lists.n_docs)
    first = bounds(0, lists.n_docs, a, b, np.arange(len(terms)))
    open_ = [first[:2] + (0,) + first[2:]] if first else []
    made = 0
    while open_:
        bound, lo, _, hi, a, b, own, at = heapq.heappop(open_)
        if bound == 0 or len(found) == k and (bound, ids[lo] is None, ids[lo]) > found[-1]:
            break  # a higher bound, or an equal one of smaller ids, would have come first
        if int((b - a).sum()) <= LEAF:
            span = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange(int((b - a).sum()))
            score = np.zeros(hi - lo, dtype=np.int64)
            np.add.at(score, lists.doc[span] - lo, lists.impact[span] * np.repeat(weights[own], b - a))
            some = np.flatnonzero(score >= (max(1, -found[-1][0]) if len(found) == k else 1))
            for d in some[np.argsort(-score[some], kind="stable")[:k]].tolist():
                give((-int(score[d]), ids[lo + d] is None, ids[lo + d]))
            continue
        split = int(lists.doc[at])
        mid = np.searchsorted(lists.key, terms[own] * lists.n_docs + split)
        mid = np.clip(mid, a, b)
        holds = (mid < b) & (lists.doc[np.minimum(mid, len(lists.doc) - 1)] == split)
        score = int((lists.impact[mid[holds]] * weights[own[holds]]).sum())
        if score:
            give((-score, ids[split] is None, ids[split]))
        for rest in (bounds(lo, split, a, mid, own), bounds(split + 1, hi, mid + holds, b, own)):
            if rest:
                made += 1
                heapq.heappush(open_, rest[:2] + (made,) + rest[2:])
    return found


def _blocks(items: DataFrame, item_col: str, text_col: str, block_terms: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_terms`` terms: (id, text) rows."""
    words = F.size(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    n = -(-(items.agg(F.sum(words)).first()[0] or 0) // block_terms)
    rows = items.select(F.col(item_col).alias("id"), F.col(text_col).cast("string").alias("text")).distinct()
    for b in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).collect()]


def _index(docs: DataFrame, wanted, id_col: str, text_col: str) -> DataFrame:
    """(ids, lengths, codes, tfs, lists, dfs, n, total) of each segment; ``wanted`` is a broadcast of sorted term hashes."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = wanted.value
        ids: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        codes: list[np.ndarray] = []
        times: list[np.ndarray] = []
        n_docs = n_codes = 0

        def done() -> pa.RecordBatch:
            held = pa.concat_arrays(ids)
            values = held.to_pylist()
            order = np.array(sorted(range(len(values)), key=lambda i: (values[i] is None, values[i])), dtype=np.int64)
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            code, tf, length = np.concatenate(codes), np.concatenate(times), np.concatenate(lengths)
            code = code % len(terms) * n_docs + place[code // len(terms)]
            by = np.argsort(code)
            code, tf = code[by], tf[by]
            own, df = np.unique(code // n_docs, return_counts=True)
            row = [held.take(pa.array(order)), length[order].astype(np.int32).tobytes(), zlib.compress(np.diff(code, prepend=0).tobytes(), 1), zlib.compress(tf.astype(np.int32).tobytes(), 1), own.astype(np.int32), df, len(order), int(length.sum())]
            listed = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), row[0])
            rest = [pa.array([x], t) for x, t in zip(row[1:], (pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64()), strict=True)]
            ids.clear(), lengths.clear(), codes.clear(), times.clear()
            return pa.RecordBatch.from_arrays([listed, *rest], ["ids", "lengths", "codes", "tfs", "lists", "dfs", "n", "total"])

        for batch in batches:
            for s in slices(batch.column(1), lower=True, gap=GAP):
                length = np.diff(s.word_from)
                full = np.flatnonzero(length)
                if not len(full):
                    continue
                hashes = term_hashes(s)
                at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                hit = np.flatnonzero(terms[at] == hashes)
                row = np.repeat(np.arange(len(full)), length[full])[hit] + n_docs
                code, tf = np.unique(row * len(terms) + at[hit], return_counts=True)
                ids.append(batch.column(0).take(pa.array(s.first + full)))
                lengths.append(length[full]), codes.append(code), times.append(tf)
                n_docs, n_codes = n_docs + len(full), n_codes + len(code)
                if n_codes >= SEGMENT or n_docs >= SEGMENT:
                    yield done()
                    n_docs = n_codes = 0
        if n_docs:
            yield done()

    schema = f"ids array<{kind.simpleString()}>, lengths binary, codes binary, tfs binary, lists array<int>, dfs array<bigint>, n bigint, total bigint"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 10, block_terms: int = 500_000) -> DataFrame:
    """(item, rank, id, score): each item's ``k`` best documents with a score above zero."""
    spark, kind, item_kind = docs.sparkSession, docs.schema[id_col].dataType, items.schema[item_col].dataType.simpleString()
    out = []
    for block in _blocks(items, item_col, item_text, block_terms):
        hashed = [np.unique(np.concatenate([term_hashes(s) for s in slices(pa.array([text], pa.string()), lower=True, gap=GAP)] or [np.zeros(0, np.uint64)])) for _, text in block]
        terms = np.unique(np.concatenate(hashed))
        if not len(terms):
            continue
        wanted = spark.sparkContext.broadcast(terms)
        index = cut(_index(docs, wanted, id_col, text_col))
        counts = index.agg(F.sum("n"), F.sum("total")).first()
        n, total = counts[0] or 0, counts[1] or 0
        df = np.zeros(len(terms), dtype=np.int64)
        for term, found in index.select(F.explode(F.arrays_zip("lists", "dfs")).alias("x")).groupBy("x.lists").agg(F.sum("x.dfs")).collect():  # the block's terms
            df[term] = found
        weights = np.array([weight(n, int(x)) if x else 0 for x in df], dtype=np.int64)
        asked = spark.sparkContext.broadcast(([np.searchsorted(terms, x) for x in hashed], weights))

        def run(batches: Iterator[pa.RecordBatch], asked=asked, n=n, total=total) -> Iterator[pa.RecordBatch]:
            wants, weights = asked.value
            best: list[list] = [[] for _ in wants]
            for batch in batches:
                for ids, lengths, codes, tfs in zip(*(batch.column(i) for i in range(4)), strict=True):
                    ids, length = ids.as_py(), np.frombuffer(lengths.as_py(), dtype=np.int32).astype(np.int64)
                    code, tf = np.cumsum(np.frombuffer(zlib.decompress(codes.as_py()), dtype=np.int64)), np.frombuffer(zlib.decompress(tfs.as_py()), dtype=np.int32).astype(np.int64)
                    term, doc = code // len(ids), code % len(ids)
                    lists = Postings(term, doc, impacts(tf, length[doc], n, total), len(ids))
                    for found, own in zip(best, wants, strict=True):
                        best_first(lists, own, weights[own], ids, found, k)
            item = [i for i, found in enumerate(best) for _ in found]
            rows = [x for found in best for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array([x[2] for x in rows], id_type), pa.array([-x[0] for x in rows], pa.int64())], ["at", "id", "score"])

        id_type = to_arrow_type(kind)
        found = index.select("ids", "lengths", "codes", "tfs").mapInArrow(run, f"at int, id {kind.simpleString()}, score bigint")
        order = Window.partitionBy("at").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"at int, item {item_kind}")
        out.append(top.join(F.broadcast(names), "at").select("item", "rank", "id", "score"))
    schema = f"item {item_kind}, rank int, id {kind.simpleString()}, score bigint"
    return reduce(lambda a, b: a.unionByName(b), out) if out else spark.createDataFrame([], schema)
