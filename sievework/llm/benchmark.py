"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared word by word, A-Z in lower case.  An item of n
words may be found with up to k = floor(``rate`` x n) word edits.  It is split
into k + 1 pieces; whatever the edits, one piece stands unchanged, so the exact
hits of pieces (rolling hashes of whole texts against one table) propose every
place.  Places of one item in one document are merged and verified with Myers'
bit-parallel distance over the words.

Items too short for an edit (k = 0) are one piece, and its hit is the match.

The benchmark is sent to the executors in blocks of at most about
``block_words`` words (one item is never split), one pass over the documents
for each block.  A block's matches are written down and its index destroyed
before the next one is built, so driver and executors hold two blocks at most,
whatever the table holds.  There is no shuffle.

Defined results: null or empty texts match nothing, and items without words
are in no document; null ids are returned as null; repeated rows give repeated
matches; items that agree in id and text are one.  Ids of any type will do, and
``keep_clean`` gives all columns back under their names, whatever these are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sievework.llm._words import LOWER_TABLE, rolling, slices
from sievework.session import cut

FILTER_BITS = 20


def budget(n: int, rate: float) -> int:
    return int(rate * n + 1e-9)


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """k + 1 neighbouring pieces of n words that differ by one word in length at most."""
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def myers(pattern: dict[int, int], m: int, text: list[int], most: int) -> tuple[int, int] | None:
    """(distance, end) of the pattern's best place in ``text`` within ``most`` edits, the first such end."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = mask, 0, m, None
    for j, word in enumerate(text):
        eq = pattern.get(word, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & mask, up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        up, down = mh | ~(xv | ph) & mask, ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Index:
    """The pieces of one block of items."""

    def __init__(self, items: list[tuple[object, np.ndarray]], rate: float):
        self.items = items
        self.k = [budget(len(w), rate) for _, w in items]
        found: dict[int, tuple[list, list]] = {}
        for i, (_, words) in enumerate(items):
            for a, b in pieces(len(words), self.k[i]):
                hashes, owners = found.setdefault(b - a, ([], []))
                hashes.append(rolling(words[a:b], b - a)[0])
                owners.append((i, a))
        self.lengths = {}
        for length, (hashes, owners) in found.items():
            order = np.argsort(np.array(hashes, dtype=np.uint64), kind="stable")
            keys = np.array(hashes, dtype=np.uint64)[order]
            few = np.zeros(1 << FILTER_BITS, dtype=bool)
            few[keys >> np.uint64(64 - FILTER_BITS)] = True
            self.lengths[length] = (keys, np.array(owners, dtype=np.int64)[order], few)
        self.patterns: dict[int, dict[int, int]] = {}

    def pattern(self, i: int) -> dict[int, int]:
        if i not in self.patterns:
            bits: dict[int, int] = {}
            for at, word in enumerate(self.items[i][1].tolist()):
                bits[word] = bits.get(word, 0) | 1 << at
            self.patterns[i] = bits
        return self.patterns[i]

    def search(self, words: np.ndarray, word_from: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, distance, start, end) of each item found in each row of a slice."""
        found = []
        for length, (keys, owners, few) in self.lengths.items():
            have = rolling(words, length)
            at = np.flatnonzero(few[have >> np.uint64(64 - FILTER_BITS)])
            lo, hi = np.searchsorted(keys, have[at]), np.searchsorted(keys, have[at], side="right")
            row = np.searchsorted(word_from, at, side="right") - 1
            good = (hi > lo) & (at + length <= word_from[row + 1])
            at, lo, hi, row = at[good], lo[good], hi[good], row[good]
            n = hi - lo
            which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            item, offset = owners[which, 0], owners[which, 1]
            found.append((np.repeat(row, n), item, np.repeat(at, n) - offset))
        if not sum(len(x[0]) for x in found):
            return
        row, item, begin = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((begin, item, row))
        row, item, begin = row[order], item[order], begin[order]
        cuts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(row)], strict=True):
            r, i = int(row[a]), int(item[a])
            first, m, k = int(word_from[r]), len(self.items[i][1]), self.k[i]
            if not k:  # one piece, the whole item
                yield r, i, 0, int(begin[a]) - first, int(begin[a]) + m - first
                continue
            best, last = None, int(word_from[r + 1])
            for x, y in merged(np.unique(begin[a:b]).tolist(), m, k):
                x, y = max(first, x), min(last, y)
                hit = myers(self.pattern(i), m, words[x:y].tolist(), k)
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], x + hit[1])
            if best:
                yield r, i, best[0], self._start(i, words[max(first, best[1] - m - k) : best[1]].tolist(), best[0], best[1]) - first, best[1] - first

    def _start(self, i: int, before: list[int], distance: int, end: int) -> int:
        """Where a match that ends at ``end`` begins: the shortest reading backwards with that distance."""
        back = self.items[i][1][::-1].tolist()
        row = list(range(len(back) + 1))
        for j, word in enumerate(reversed(before)):
            new = [j + 1]
            for x in range(1, len(back) + 1):
                new.append(min(row[x - 1] + (back[x - 1] != word), row[x] + 1, new[-1] + 1))
            row = new
            if row[-1] == distance:
                return end - j - 1
        return end


def merged(begins: list[int], m: int, k: int) -> Iterator[tuple[int, int]]:
    """Windows around proposed starts, those that overlap joined."""
    a = b = None
    for x in begins:
        if b is not None and x - k <= b:
            b = x + m + k
            continue
        if b is not None:
            yield a, b
        a, b = x - k, x + m + k
    if b is not None:
        yield a, b


def _blocks(items: DataFrame, id_col: str, text_col: str, rate: float, block_words: int) -> Iterator[tuple[bool, Index]]:
    """(is it the last, its index) for each block of the items."""
    words = F.size(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"))
    total = items.agg(F.sum(words)).first()[0] or 0
    n = -(-total // block_words)
    for b in range(n):
        own = items.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n)) == b) if n > 1 else items
        rows = own.select(F.col(id_col), F.col(text_col).cast("string")).distinct().collect()  # about block_words words
        found = []
        for i, text in sorted(rows, key=lambda r: (r[1] or "", r[0] is None, str(r[0]))):
            for s in slices(pa.array([text], pa.string()), lower=True):
                if len(s.starts):
                    found.append((i, s.word_hashes()))
        yield b == n - 1, Index(found, rate)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = 0.2, block_words: int = 1_000_000) -> DataFrame:
    """(id, item_id, distance, item_words, start_word, end_word): each item found in each document, at its best place."""
    kind, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType
    names = ["id", "item_id", "distance", "item_words", "start_word", "end_word"]
    types = (to_arrow_type(item_type), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    schema = f"id {kind}, item_id {item_type.simpleString()}, distance int, item_words int, start_word bigint, end_word bigint"
    read = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    scans = []
    for last, index in _blocks(items, item_col, item_text, rate, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            x = sent.value
            for batch in batches:
                rows, out = [], []
                for s in slices(batch.column(1), lower=True):
                    for r, i, d, a, b in x.search(s.word_hashes(), s.word_from):
                        rows.append(s.first + r)
                        out.append((x.items[i][0], d, len(x.items[i][1]), a, b))
                if rows:
                    columns = [pa.array([o[k] for o in out], t) for k, t in enumerate(types)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *columns], names)

        scans.append(read.mapInArrow(run, schema))
        if not last:
            scans[-1] = cut(scans[-1])
            sent.destroy()
    return reduce(lambda a, b: a.unionByName(b), scans) if scans else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = 0.2, block_words: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns; a pass without a join for each block."""
    at, schema, out = docs.columns.index(text_col), docs.schema, docs
    for last, index in _blocks(items, item_col, item_text, rate, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for s in slices(batch.column(at).cast(pa.string()), lower=True):
                    for r, *_ in sent.value.search(s.word_hashes(), s.word_from):
                        clean[s.first + r] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, schema)
        if not last:
            out = cut(out)
            sent.destroy()
    return out


def lower_words(text: str) -> list[bytes]:
    return text.encode().translate(LOWER_TABLE).split()
