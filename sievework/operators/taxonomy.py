"""Signals, candidate collections, scores, tiers and greedy promotion."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import match_text, words
from sievework.session import cut, cut_round


def signals(items: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(asset, dim, term) of vocabulary terms (dim, term, alias, parent) among an item's words, with each term's parent."""
    w = items.select(F.col(id_col).alias("asset"), F.explode(words(match_text(F.col(text_col)))).alias("alias")).distinct()
    met = w.join(vocabulary, "alias")
    return met.select("asset", "dim", "term").unionByName(met.where("parent is not null").select("asset", "dim", F.col("parent").alias("term"))).distinct()


def candidates(found: DataFrame, least: int) -> DataFrame:
    """(hub, dim, term, n): terms with at least ``least`` assets."""
    c = found.groupBy("dim", "term").agg(F.count_distinct("asset").alias("n")).where(F.col("n") >= least)
    return c.select(F.concat_ws(":", "dim", "term").alias("hub"), "dim", "term", "n")


def evidence(found: DataFrame, cands: DataFrame, items: DataFrame, category: str, k: int) -> DataFrame:
    """T4: (hub, categories, top): number of categories and the ``k`` commonest."""
    met = cands.join(found, ["dim", "term"]).join(items.select(F.col("asset"), F.col(category).alias("category")), "asset")
    n = met.groupBy("hub", "category").agg(F.count("*").alias("c"))
    n = n.withColumn("rn", F.row_number().over(Window.partitionBy("hub").orderBy(F.desc("c"), "category")))
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= k, F.struct("rn", "category")))), lambda x: x["category"]), ",")
    return n.groupBy("hub").agg(F.count("*").alias("categories"), top.alias("top"))


def _top(counts: DataFrame, name: str, value: str, k: int) -> DataFrame:
    """(hub, name): the ``k`` commonest values of each hub, by count and then value, as (value, n)."""
    ranked = counts.withColumn("_rn", F.row_number().over(Window.partitionBy("hub").orderBy(F.desc("c"), value))).where(F.col("_rn") <= k)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_rn", F.col(value).alias("value"), F.col("c").alias("n")))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n")))
    return ranked.groupBy("hub").agg(listed.alias(name))


def full_evidence(found: DataFrame, cands: DataFrame, items: DataFrame, dims: Sequence[str], k: int = 12, most: int = 20, examples: int = 12) -> DataFrame:
    """T4: a hub's evidence: how many categories its members have and the ``most`` commonest, the ``k`` commonest terms of each dimension among its members' signals, and its first members.

    found: (asset, dim, term), items: (asset, category, file).  Columns:
    ``categories``, ``top_categories``, one column for each of ``dims`` (arrays
    of (value, n)) and ``examples`` (array of (asset, file), smallest ids
    first).  Counts are made before anything is ranked, so a hub's members are
    never gathered.
    """
    members = cut(cands.join(found, ["dim", "term"]).select("hub", "asset").distinct())
    met = members.join(items.select("asset", "category", "file"), "asset")
    by_category = met.groupBy("hub", "category").agg(F.count("*").alias("c"))
    out = cands.select("hub").join(by_category.groupBy("hub").agg(F.count("category").alias("categories")), "hub", "left").join(_top(by_category.where("category is not null"), "top_categories", "category", most), "hub", "left")
    terms = cut(members.join(found.distinct(), "asset").groupBy("hub", "dim", "term").agg(F.count("*").alias("c")))
    for dim in dims:
        out = out.join(_top(terms.where(F.col("dim") == dim), dim, "term", k), "hub", "left")
    first = met.withColumn("_rn", F.row_number().over(Window.partitionBy("hub").orderBy("asset"))).where(F.col("_rn") <= examples)
    return out.join(first.groupBy("hub").agg(F.array_sort(F.collect_list(F.struct("asset", "file"))).alias("examples")), "hub", "left")


def ladder(c: Column, steps: list[tuple[float, float]], low: float) -> Column:
    """The value of the first threshold reached."""
    out = F.when(c >= steps[0][0], steps[0][1])
    for least, value in steps[1:]:
        out = out.when(c >= least, value)
    return out.otherwise(low)


def scored(cands: DataFrame) -> DataFrame:
    """Size and breadth scores, weighted and clamped, with a tier and reasons; cands: (hub, n, categories)."""
    size = ladder(F.col("n"), [(400, 100.0), (150, 85.0), (60, 65.0), (20, 40.0)], 10.0)
    breadth = ladder(F.col("categories"), [(6, 100.0), (4, 70.0), (2, 40.0)], 10.0)
    final = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), size * 0.65 + breadth * 0.35)), 4)
    tier = F.when(F.col("score") >= 85, "core").when(F.col("score") >= 60, "phase2").when(F.col("score") >= 35, "backlog").otherwise("reject")
    reasons = F.array_compact(F.array(F.when(F.col("n") < 60, "small"), F.when(F.col("categories") < 3, "narrow")))
    return cands.withColumn("score", final).withColumn("tier", tier).withColumn("reasons", F.array_join(reasons, ","))


def related_by_terms(a: DataFrame) -> DataFrame:
    """(hub, other, shared) of hubs over shared (hub, term) rows."""
    t = a.select("hub", "term").distinct()
    return t.join(t.select(F.col("hub").alias("other"), "term"), "term").where("hub <> other").groupBy("hub", "other").agg(F.count("*").alias("shared"))


def related_candidates(terms: DataFrame, categories: DataFrame, members: DataFrame, k: int = 10, weights: tuple[int, int, int, int] = (10, 2, 8, 20)) -> DataFrame:
    """(hub, other, score, rank): each hub's ``k`` most related ones, by score and then name.

    ``weights``: points for a shared term, points for a shared category, the
    most that shared members give, and how many of them give a point.  terms:
    (hub, term), categories: (hub, category), members: (hub, asset), of the hubs
    that may be related.  Each is met over its own key and counted; a hub that
    shares nothing has no rows.
    """
    by_term, by_category, most, each = weights

    def shared(rows: DataFrame, key: str, name: str) -> DataFrame:
        r = rows.where(F.col(key).isNotNull()).select("hub", key).distinct()
        met = r.join(r.withColumnRenamed("hub", "other"), key).where("hub <> other")
        return met.groupBy("hub", "other").agg(F.count("*").alias("n")).select("hub", "other", F.lit(name).alias("kind"), "n")

    rows = shared(terms, "term", "term").unionByName(shared(categories, "category", "category")).unionByName(shared(members, "asset", "member"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    score = of("term") * by_term + of("category") * by_category + F.least(F.lit(most), F.floor(of("member") / each))
    scored_pairs = rows.groupBy("hub", "other").agg(score.cast("bigint").alias("score")).where("score > 0")
    return scored_pairs.withColumn("rank", F.row_number().over(Window.partitionBy("hub").orderBy(F.desc("score"), "other"))).where(F.col("rank") <= k)


def redundant_pairs(overlaps: DataFrame, kinds: DataFrame, scale: float = 1.35, same: float = 0.9, combined: float = 0.92) -> DataFrame:
    """(hub, other, ratio): ``other``, if it is kept, makes ``hub`` redundant.

    Either both are of one scale (the larger at most ``scale`` times the
    smaller) and share ``same`` of the smaller, or ``hub`` is a combination,
    ``other`` is none and they share ``combined``.  overlaps: (hub, other,
    common, hub_size, other_size), kinds: (hub, combination).
    """
    small, large = F.least("hub_size", "other_size"), F.greatest("hub_size", "other_size")
    ratio = F.col("common") / small
    met = overlaps.join(kinds.select("hub", F.col("combination").alias("mine")), "hub").join(kinds.select(F.col("hub").alias("other"), F.col("combination").alias("theirs")), "other")
    alike = (large <= small * scale) & (ratio >= same)
    return met.where(alike | (F.col("mine") & ~F.col("theirs") & (ratio >= combined))).select("hub", "other", ratio.alias("ratio"))


def _grams(words: np.ndarray, row: np.ndarray, halt: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, phrase hash, place of its first word) of each phrase of one row that neither begins nor ends with a stop word."""
    stop = np.isin(words, halt)
    mixed = words.astype(np.uint64)
    hashes = np.zeros(len(words), dtype=np.uint64)
    for n in range(1, most + 1):
        last = np.arange(n - 1, len(words))
        if not len(last):
            return
        hashes = (hashes[: len(last)] + mixed[last]) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
        first = last - (n - 1)
        good = (row[first] == row[last]) & ~stop[first] & ~stop[last]
        yield n, ((hashes + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9))[good], first[good]


def _cells_for(places: int) -> int:
    """A power of two of cells, about one for each place of a phrase: few rare phrases then share a cell with as many places as a common one has."""
    return 1 << min(29, max(22, int(places).bit_length()))


def _common_cells(words: DataFrame, halt: np.ndarray, least: int, most: int, cells: int) -> np.ndarray:
    """Which of ``cells`` (a power of two) hold ``least`` places of phrases or more, by the phrases' hashes; one bit each."""
    shards, kind = 64, np.uint8 if least < 128 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, dtype=kind)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                own, row = _flat(batch.column(0).slice(at, 2000))
                for _, hashes, _ in _grams(own, row, halt, most):
                    cell, n = np.unique(hashes & np.uint64(cells - 1), return_counts=True)
                    total[cell] = np.minimum(total[cell] + n, least)
        for shard, part in enumerate(total.reshape(shards, -1)):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["shard", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, counts in zip(*(batch.column(i) for i in (0, 1)), strict=True):
                x = np.frombuffer(zlib.decompress(counts.as_py()), dtype=kind)
                sums[shard.as_py()] = np.minimum(sums.get(shard.as_py(), kind(0)) + x, kind(least))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(x >= least).tobytes() for x in sums.values()], pa.binary())], ["shard", "bits"])

    met = words.select("words").mapInArrow(count, "shard int, counts binary").repartition("shard").mapInArrow(merge, "shard int, bits binary")
    out = np.zeros((shards, cells // shards // 8), dtype=np.uint8)
    for r in met.toLocalIterator():  # one bit for each cell
        out[r.shard] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.reshape(-1)


def _marks(rows: np.ndarray, hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The two of ``cells`` (a power of two) that stand for a phrase in a row, both by their hashes."""
    x = (rows.astype(np.uint64) + hashes) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return (x & np.uint64(cells - 1)).astype(np.int64), ((x >> np.uint64(32)) & np.uint64(cells - 1)).astype(np.int64)


def _marked(pairs: DataFrame, cells: int) -> np.ndarray:
    """``cells`` bits, of which those of each (row, h) are set."""
    shards = 64

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(cells >> 3, dtype=np.uint8)
        for batch in batches:
            for at in _marks(*(batch.column(i).to_numpy().view(np.uint64) for i in (0, 1)), cells):
                np.bitwise_or.at(bits, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        for shard, part in enumerate(bits.reshape(shards, -1)):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["shard", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, bits in zip(*(batch.column(i) for i in (0, 1)), strict=True):
                sums[shard.as_py()] = sums.get(shard.as_py(), np.uint8(0)) | np.frombuffer(zlib.decompress(bits.as_py()), dtype=np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["shard", "bits"])

    out = np.zeros((shards, cells // shards // 8), dtype=np.uint8)
    for r in pairs.mapInArrow(mark, "shard int, bits binary").repartition("shard").mapInArrow(merge, "shard int, bits binary").toLocalIterator():
        out[r.shard] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.reshape(-1)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the row of each."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)


def mined_phrases(docs: DataFrame, key: str, source: str, tokens: str, stop: Sequence[str], least: int, most: int = 3, cells: int | None = None) -> DataFrame:
    """(phrase, size, n, sources) of 1- to ``most``-word phrases in at least ``least`` rows that neither begin nor end with a stop word.

    A first pass counts the places of phrases in ``cells`` cells by hash: a
    phrase whose cell holds fewer than ``least`` cannot be in that many rows, so
    most of those that stand once never leave their task.  Cells follow the
    number of words, from 2^22 (half a megabyte to broadcast) to 2^29 (64 MB);
    beyond some phrases a cell more of them go on, and the result stays the
    same.  The others are counted by a 64-bit hash, once per row, and
    added up by batch before they are shuffled.  Each one kept is read from its first row: a
    bit map of (row, phrase), 2^29 bits at most, tells which those are, so texts
    are not shuffled, and what it lets through besides has the same name or is not
    kept; phrases as strings are made for the result alone.  Null token lists have no phrases; null sources count as one.
    """
    # a Parquet table writes a word and its hash once for many rows
    rows = cut_round(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(tokens).alias("tokens"), F.transform(tokens, lambda w: F.xxhash64(w)).alias("words")).where(F.col(tokens).isNotNull()))
    halt = np.array([r.h for r in rows.sparkSession.createDataFrame([(w,) for w in stop], "w string").select(F.xxhash64("w").alias("h")).collect()], dtype=np.int64)
    kind = rows.schema["key"].dataType

    cells = cells or _cells_for(most * (rows.agg(F.sum(F.size("words"))).first()[0] or 0))
    common = rows.sparkSession.sparkContext.broadcast(_common_cells(rows, halt, least, most, cells))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                words, row = _flat(some.column(2))
                bits = common.value
                order = pc.sort_indices(some.column(0)).to_numpy()
                place = np.empty(len(order), dtype=np.int64)
                place[order] = np.arange(len(order))
                codes = some.column(1).dictionary_encode()
                of = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
                for _, hashes, first in _grams(words, row, halt, most):
                    cell = (hashes & np.uint64(cells - 1)).astype(np.int64)
                    kept = (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
                    hashes, first = hashes[kept], first[kept]
                    if not len(hashes):
                        continue
                    by = np.lexsort((place[row[first]], of[row[first]], hashes))
                    h, o, r = hashes[by], of[row[first]][by], place[row[first]][by]
                    new = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1]) | (r[1:] != r[:-1]))  # once a row
                    h, o, r = h[new], o[new], r[new]
                    group = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])))
                    n = np.diff(np.append(group, len(h)))
                    names = pa.concat_arrays([codes.dictionary, pa.nulls(1, pa.string())]).take(pa.array(o[group]))
                    yield pa.RecordBatch.from_arrays([pa.array(h[group].view(np.int64)), names, pa.array(n), some.column(0).take(pa.array(order[r[group]]))], ["h", "source", "n", "key"])

    parts = rows.select("key", "source", "words").mapInArrow(count, f"h bigint, source string, n bigint, key {kind.simpleString()}")
    by_source = parts.groupBy("h", "source").agg(F.sum("n").alias("n"), F.min("key").alias("key"))
    kept = cut_round(by_source.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("sources"), F.min("key").alias("key")).where(F.col("n") >= least))
    spots = min(1 << 29, max(1 << 16, 1 << (16 * kept.count()).bit_length()))
    firsts = rows.sparkSession.sparkContext.broadcast(_marked(kept.select(F.xxhash64("key").alias("row"), "h"), spots))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 2000) for b in batches for at in range(0, b.num_rows, 2000)):
            words, row = _flat(batch.column(1))
            text, of, bits = batch.column(0).flatten(), batch.column(2).to_numpy().view(np.uint64), firsts.value
            for n, hashes, first in _grams(words, row, halt, most):
                hit = np.ones(len(hashes), dtype=bool)
                for at in _marks(of[row[first]], hashes, spots):
                    hit &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                own, at = np.unique(hashes[hit].view(np.int64), return_index=True)
                phrases = [" ".join(text.slice(i, n).to_pylist()) for i in first[hit][at].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([n] * len(phrases), pa.int32()), pa.array(phrases, pa.string())], ["h", "size", "phrase"])

    named = rows.select("tokens", "words", F.xxhash64("key").alias("row")).mapInArrow(name, "h bigint, size int, phrase string").distinct()
    return kept.join(named, "h").select("phrase", "size", "n", "sources")


def decision() -> Column:
    """From (size, n, sources)."""
    return F.when((F.col("size") == 1) & (F.col("n") > 150), "generic").when(F.col("sources") < 3, "narrow").when(F.col("n") >= 40, "promote").when(F.col("n") >= 15, "review").otherwise("reject")


def intent_share(membership: DataFrame, titles: DataFrame, token: Column) -> DataFrame:
    """(hub, share): how many members' titles hold a token of the hub's route."""
    met = membership.join(titles, "asset").withColumn("hit", F.contains(F.lower("title"), token))
    return met.groupBy("hub").agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("share"))


def intent_evidence(membership: DataFrame, titles: DataFrame, slugs: DataFrame, stop: Sequence[str], weak: float = 0.35) -> DataFrame:
    """(hub, members, hits, share, evidence): how many members' titles hold a token of the hub's slug.

    Tokens are the slug's parts of three letters or more that aren't stop
    words; a hub without any is ``no-token``, below ``weak`` it is ``weak``,
    else ``direct``.  membership: (hub, asset), titles: (asset, title), slugs:
    (hub, slug).
    """
    token = F.filter(F.split(F.lower("slug"), "-"), lambda t: (F.length(t) > 2) & ~t.isin(*stop))
    met = membership.join(slugs.select("hub", token.alias("tokens")), "hub").join(titles, "asset", "left")
    hit = F.exists("tokens", lambda t: F.contains(F.lower(F.coalesce("title", F.lit(""))), t))
    n = met.groupBy("hub").agg(F.count("*").alias("members"), F.count_if(hit).alias("hits"), F.max(F.size("tokens")).alias("tokens"))
    share = F.round(F.col("hits") / F.col("members"), 6)
    return n.select("hub", "members", "hits", share.alias("share"), F.when(F.col("tokens") == 0, "no-token").when(share < weak, "weak").otherwise("direct").alias("evidence"))


def greedy_promotion(cands: DataFrame, overlaps: DataFrame, least: float, cap: int) -> DataFrame:
    """(hub, score, state) of candidates in rank order, ``redundant`` if an earlier kept one overlaps by ``least``; at most ``cap`` are ``selected``.

    cands: (hub, score); overlaps: (hub, other, ratio).  The sequential rule is
    reached in rounds of joins: a candidate none of whose open neighbours
    stands before it is settled as kept, and what overlaps it as left out,
    until none is open; the first ``cap`` kept ones are selected (one beyond
    the cap could only block others beyond it).
    """
    rank = F.struct((-F.col("score")).alias("s"), F.col("hub").alias("h"))
    open_ = cut(cands.select("hub", "score").withColumn("rank", rank))
    near = overlaps.where((F.col("ratio") >= least) & (F.col("hub") != F.col("other"))).select("hub", "other").distinct()
    before = cut(near.join(open_.select("hub", "rank"), "hub").join(open_.select(F.col("hub").alias("other"), F.col("rank").alias("other_rank")), "other").where("other_rank < rank").select("hub", "other"))
    kept = None
    while not open_.isEmpty():
        waits = before.join(open_.select(F.col("hub").alias("other")), "other", "left_semi").select("hub").distinct()
        now = cut_round(open_.join(waits, "hub", "left_anti"))
        gone = cut_round(open_.join(before.join(now.select(F.col("hub").alias("other")), "other", "left_semi").select("hub").distinct(), "hub", "left_semi"))
        kept = now if kept is None else kept.unionByName(now)
        open_ = cut_round(open_.join(now.select("hub"), "hub", "left_anti").join(gone.select("hub"), "hub", "left_anti"))
    if kept is None:
        return cands.select("hub", "score", F.lit("selected").alias("state"))
    first = cut(kept.orderBy("rank").limit(cap).select("hub").withColumn("_in", F.lit(True)))
    blocked = before.join(first.select(F.col("hub").alias("other")), "other", "left_semi").select("hub").distinct().withColumn("_blocked", F.lit(True))
    state = F.when(F.col("_in"), "selected").when(F.col("_blocked"), "redundant").otherwise("over-cap")
    return cands.select("hub", "score").join(first, "hub", "left").join(blocked, "hub", "left").select("hub", "score", state.alias("state"))
