"""Exact removal of repeated word windows behind a count-min prefilter.

A window is ``window`` consecutive words of one document.  A word goes if a
window over it also starts earlier (smaller id, or earlier in the same
document).  Two passes:

1. Every window has an anchor: the smallest hash among its ``gram``-word runs.
   Equal windows have equal anchors at equal offsets, so the number of places
   of an anchor is never below the number of places of any window that it
   stands for.  Each partition counts its anchors' places in a sketch (sorted
   cell numbers and counts, by shard of the cell range); shards are merged
   where they meet and only come back as one bit per cell: counted twice or
   more.  A count-min estimate is never too low, so no repeated window is lost.
2. Only windows whose anchor is estimated repeated are grouped exactly, by 128
   bits (anchor and window hash).  Neighbouring windows of one anchor travel as
   one row.  Each batch keeps only the earliest of its own equal windows and
   marks the others at once; anchors counted ``HOT`` times or more travel by
   window instead of by anchor.  So neither a passage nor a phrase that a third
   of all documents hold meets in one task.

The sketch has a width in proportion to the text, at most ``max_cells``.  What
is brought to the driver, shard after shard, and broadcast is one bit for each
cell (``max_cells / 8`` bytes at most: 134 MB) and the numbers of the cells
counted ``HOT`` times (8 bytes for 255 places).  Beyond that width more windows
reach the second pass; results stay the same.

Defined results: null text has no words; rows with a null id come after all
others; repeated rows of one id and text are one document (none of them is
earlier than the other).  Ids that aren't whole numbers are numbered in their
order first.  Only the id and text columns are read, whatever the names of the
others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm._words import mix, rolling, slices
from sievework.operators.records import positions

SHARD_BITS = 20
HOT = 255
DEPTH = 2
RUN = 16
LAST = np.iinfo(np.int64).max


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each run of ``width`` values, by doubling."""
    have, n = x, 1
    while n * 2 <= width:
        have = pick(have[:-n], have[n:])
        n *= 2
    if n < width:
        have = pick(have[: len(have) - (width - n)], have[width - n :])
    return have


def anchors(words: np.ndarray, word_from: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, anchor of each window, is the window inside one document)."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    grams = rolling(words, gram)
    least = _sliding(grams, window - gram + 1, np.minimum)[:n]
    row = np.repeat(np.arange(len(word_from) - 1), np.diff(word_from))
    return grams, least, row[:n] == row[window - 1 :]


def places(grams: np.ndarray, least: np.ndarray, inside: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchors, once for each place at which one stands."""
    if not len(least):
        return least
    span = window - gram + 1
    seen = np.zeros(len(least) + 2 * (span - 1), dtype=np.uint64)
    seen[span - 1 : span - 1 + len(least)] = np.where(inside, least, 0)
    top = _sliding(seen, span, np.maximum)[: len(grams)]
    return grams[: len(top)][(grams[: len(top)] == top) & (top > 0)]


def cells_of(anchor: np.ndarray, bits: int) -> list[np.ndarray]:
    """The sketch's cell of each anchor in each of its ``DEPTH`` rows of 2**bits cells."""
    return [(mix(anchor, 11 + d) >> np.uint64(64 - bits)).astype(np.int64) + (d << bits) for d in range(DEPTH)]


def repeated_cells(docs: DataFrame, text_col: str, window: int, gram: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the partitions' sketches: (packed bits of cells counted twice or more, sorted numbers of cells counted HOT times)."""
    n_shards = max(1, DEPTH << max(0, bits - SHARD_BITS))
    width = (DEPTH << bits) // n_shards

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            cells, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(cells, np.arange(n_shards + 1) * width)
            ids, found, times = [], [], []
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                own = cells[cuts[k] : cuts[k + 1]] - k * width
                ids.append(k)
                found.append(zlib.compress(np.diff(own, prepend=0).astype(np.uint32).tobytes(), 1))
                times.append(zlib.compress(np.minimum(counts[cuts[k] : cuts[k + 1]], HOT).astype(np.uint8).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(found, pa.binary()), pa.array(times, pa.binary())], ["shard", "cells", "counts"])

        for batch in batches:
            for s in slices(batch.column(0)):
                grams, least, inside = anchors(s.word_hashes(), s.word_from, window, gram)
                at = places(grams, least, inside, window, gram)
                if len(at):
                    held += cells_of(at, bits)
                    n += DEPTH * len(at)
                if n > 4_000_000:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, sums = None, np.zeros(width, dtype=np.uint16)

        def done() -> pa.RecordBatch:
            packed = [zlib.compress(x.tobytes(), 1) for x in (np.packbits(sums >= 2), np.flatnonzero(sums >= HOT).astype(np.int32))]
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], ["shard", "twice", "hot"])

        for batch in batches:
            for k, cells, times in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != shard:
                    if shard is not None:
                        yield done()
                    shard, sums = k, np.zeros(width, dtype=np.uint16)
                at = np.cumsum(np.frombuffer(zlib.decompress(cells), dtype=np.uint32), dtype=np.int64)
                sums[at] = np.minimum(sums[at] + np.frombuffer(zlib.decompress(times), dtype=np.uint8), HOT)
        if shard is not None:
            yield done()

    sketches = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "shard int, cells binary, counts binary")
    merged = sketches.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "shard int, twice binary, hot binary")
    out, hot = np.zeros((n_shards, -(-width // 8)), dtype=np.uint8), []
    for row in merged.toLocalIterator():  # a part of the shards at a time
        out[row.shard] = np.frombuffer(zlib.decompress(row.twice), dtype=np.uint8)
        hot.append(np.frombuffer(zlib.decompress(row.hot), dtype=np.int32).astype(np.int64) + row.shard * width)
    return out.reshape(-1), np.sort(np.concatenate([*hot, np.zeros(0, np.int64)]))


def _is_set(bitmap: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bitmap[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)


def _estimate(bitmap: np.ndarray, anchor: np.ndarray, bits: int) -> np.ndarray:
    hit = np.ones(len(anchor), dtype=bool)
    for cells in cells_of(anchor, bits):
        hit &= _is_set(bitmap, cells)
    return hit


def _is_hot(hot: np.ndarray, anchor: np.ndarray, bits: int) -> np.ndarray:
    hit = np.full(len(anchor), len(hot) > 0)
    if len(hot):
        for cells in cells_of(anchor, bits):
            hit &= hot[np.minimum(np.searchsorted(hot, cells), len(hot) - 1)] == cells
    return hit


def _first_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys (the last two are id and start); True where a window's first place stands."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for k in keys[:-2]:
        x = k[order]
        same &= x[1:] == x[:-1]
    new[1:] = ~same
    # a repeated row's windows stand at the very place of the first one
    doc, start = keys[-2][order], keys[-1][order]
    group = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    first = (doc == doc[group]) & (start == start[group])
    flags = np.empty(len(order), dtype=bool)
    flags[order] = first
    lead = np.empty(len(order), dtype=bool)
    lead[order] = new
    return flags, lead


def _runs(order_doc: np.ndarray, start: np.ndarray, anchor: np.ndarray | None = None) -> np.ndarray:
    """Where a run of neighbouring windows begins: same document, next start, same anchor, at most RUN."""
    n = len(start)
    begin = np.ones(n, dtype=bool)
    begin[1:] = (order_doc[1:] != order_doc[:-1]) | (start[1:] != start[:-1] + 1)
    if anchor is not None:
        begin[1:] |= anchor[1:] != anchor[:-1]
    at = np.arange(n)
    since = at - np.maximum.accumulate(np.where(begin, at, 0))
    return begin | (since % RUN == 0)


ROWS = "route bigint, anchor bigint, doc bigint, content bigint, start int, n int, hashes binary"
NAMES = ["route", "anchor", "doc", "content", "start", "n", "hashes"]


def repeats(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int, max_cells: int) -> DataFrame:
    """(doc, content, start, mask): windows that also start earlier; bit i of mask is the window at start + i."""
    size = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    bits = max(12, min(int(max_cells // DEPTH).bit_length() - 1, int(size // 10).bit_length()))
    found = repeated_cells(docs, text_col, window, gram, bits)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice, hot = shared.value
        for batch in batches:
            ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            content = batch.column(1).to_numpy(zero_copy_only=False)
            held: list[list[np.ndarray]] = [[] for _ in range(6)]
            for s in slices(batch.column(2)):
                words = s.word_hashes()
                _, least, inside = anchors(words, s.word_from, window, gram)
                at = np.flatnonzero(inside)
                at = at[_estimate(twice, least[at], bits)]
                if len(at):
                    row = np.searchsorted(s.word_from, at, side="right") - 1
                    for k, x in enumerate((least[at], rolling(words, window)[at], ids[s.first + row], content[s.first + row], (at - s.word_from[row]).astype(np.int32))):
                        held[k].append(x)
            if held[0]:
                yield from _rows(*(np.concatenate(x) for x in held[:5]), hot, bits)

    def _rows(anchor, window_hash, doc, content, start, hot, bits) -> Iterator[pa.RecordBatch]:
        earliest, lead = _first_of(anchor, window_hash, doc, start)
        late = ~earliest
        for keep, is_mark in ((late, True), (lead & earliest, False)):
            a, h, d, c, s = (x[keep] for x in (anchor, window_hash, doc, content, start))
            if not len(a):
                continue
            if is_mark:
                yield _pack(np.zeros(len(d), np.uint64), np.zeros(len(d), np.uint64), d, c, s, None, _runs(d, s))
                continue
            by_window = _is_hot(hot, a, bits)
            for some, single in ((~by_window, False), (by_window, True)):
                if some.any():
                    begin = np.ones(int(some.sum()), bool) if single else _runs(d[some], s[some], a[some])
                    route = mix(a[some] ^ h[some], 3) if single else a[some]
                    yield _pack(route, a[some], d[some], c[some], s[some], h[some], begin)

    def _pack(route, anchor, doc, content, start, hashes, begin) -> pa.RecordBatch:
        at = np.flatnonzero(begin)
        n = np.diff(np.append(at, len(begin))).astype(np.int32)
        if hashes is None:  # marks need no meeting: they go by document
            data, route = pa.nulls(len(at), pa.binary()), mix(doc[at].astype(np.uint64), 5)
        else:
            offsets = np.append(at, len(begin)).astype(np.int32) * 8
            data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(hashes).tobytes())])
            route = route[at]
        columns = [pa.array(route.astype(np.uint64).view(np.int64)), pa.array(anchor[at].view(np.int64)), pa.array(doc[at]), pa.array(content[at]), pa.array(start[at]), pa.array(n), data]
        return pa.RecordBatch.from_arrays(columns, NAMES)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: dict = {"route": None, "seen": {}}
        for batch in batches:
            hashes = batch.column(6)
            passed = np.array(hashes.is_null())
            if passed.any():
                own = batch.filter(pa.array(passed))
                n = own.column(5).to_numpy(zero_copy_only=False)
                yield _marks(*(own.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)), (1 << n.astype(np.int64)) - 1)
            if passed.all():
                continue
            rest = batch.filter(pa.array(~passed))
            n = rest.column(5).to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(rest.num_rows), n)
            offset = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            flat = np.frombuffer(b"".join(rest.column(6).to_pylist()), dtype=np.uint64)
            route, anchor, doc, start = (rest.column(i).to_numpy(zero_copy_only=False)[at] for i in (0, 1, 2, 4))
            start = start + offset
            earliest, _ = _first_of(route, anchor, flat, doc, start)
            late = ~earliest
            # the first route may have begun in the batch before, the last may go on in the next
            if carried["route"] is not None and route[0] == carried["route"]:
                for i in np.flatnonzero(route == route[0]).tolist():
                    if (first := carried["seen"].get((anchor[i], flat[i]))) is not None and first != (doc[i], start[i]):
                        late[i] = True
            if carried["route"] != route[-1]:
                carried = {"route": route[-1], "seen": {}}
            for i in np.flatnonzero((route == route[-1]) & earliest).tolist():
                carried["seen"].setdefault((anchor[i], flat[i]), (doc[i], start[i]))
            mask = np.bincount(at, weights=np.where(late, 1 << offset, 0), minlength=rest.num_rows).astype(np.int64)
            hit = mask > 0
            if hit.any():
                yield _marks(*(rest.column(i).to_numpy(zero_copy_only=False)[hit] for i in (2, 3, 4)), mask[hit])

    def _marks(doc, content, start, mask) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(content), pa.array(start.astype(np.int32)), pa.array(mask.astype(np.int32))], ["doc", "content", "start", "mask"])

    read = docs.select(F.col(id_col).cast("bigint"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    met = read.mapInArrow(emit, ROWS).repartition("route").sortWithinPartitions("route", "anchor", "doc", "start")
    return met.mapInArrow(mark, "doc bigint, content bigint, start int, mask int")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 8, max_cells: int = 1 << 30) -> DataFrame:
    """(id, n_words, n_removed, kept): each document's words that stay, joined by one space."""
    given = docs.schema[id_col].dataType
    number = F.col(id_col).cast("bigint")
    if not isinstance(given, T.IntegralType):
        ranks = positions(docs.select(F.col(id_col).alias("id")).where("id is not null").distinct(), "id").withColumnRenamed("id", "ranked")
        docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ranks, F.col("id") == F.col("ranked"), "left").drop("ranked")
        id_col, text_col, number = "id", "text", F.col("position").cast("bigint")
    docs = docs.select(F.col(id_col).alias("id"), number.alias("number"), F.col(text_col).alias("text"))
    found = repeats(docs, "number", "text", window, gram, max_cells)
    by_doc = found.groupBy("doc", "content").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))  # of one document's own words
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("id", text.alias("text"), F.coalesce("number", F.lit(int(LAST))).alias("doc"), F.xxhash64(text).alias("content"))
    joined = keyed.join(by_doc, ["doc", "content"], "left").select("id", "text", F.col("marks.start").alias("starts"), F.col("marks.mask").alias("masks"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = np.arange(RUN)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                counts, gone, kept = [], [], []
                for text, starts, masks in zip(some.column(1).cast(pa.large_binary()), some.column(2), some.column(3), strict=True):
                    words = text.as_py().split()
                    counts.append(len(words))
                    if not starts.is_valid:
                        gone.append(0)
                        kept.append(b" ".join(words))
                        continue
                    first, mask = starts.values.to_numpy(zero_copy_only=False), masks.values.to_numpy(zero_copy_only=False)
                    where = (first[:, None] + bit)[(mask[:, None] >> bit & 1).astype(bool)]
                    change = np.bincount(where, minlength=len(words) + 1) - np.bincount(where + window, minlength=len(words) + 1)
                    covered = np.cumsum(change[: len(words)]) > 0
                    gone.append(int(covered.sum()))
                    kept.append(b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c]))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(keep, f"id {given.simpleString()}, n_words bigint, n_removed bigint, kept string")
