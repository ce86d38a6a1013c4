"""Line dedup by pairwise patience alignment.

1. Each document becomes the hashes of its lines, white space at the ends
   dropped and blank lines left out.  Documents of one and the same line
   sequence form a class; its smallest id stands for it, and the others align
   with it as a whole.
2. A key is a minimal run of consecutive lines that reaches ``block_bytes``,
   from a line onwards or from a line back; a long line is a run of one.  The
   runs of a block that is to be deleted cover all of it, so a block of short
   lines has keys of its own.  Every holder of a key is paired with its earliest
   holder: a run that any earlier document holds stands in that one too, so no
   other pair can add to it, and thousands of copies cost one pair each.
3. Each pair is aligned with patience diff over the line hashes: common ends,
   then lines that both sides hold once in a longest increasing run, then the
   parts between them again.  Aligned blocks of ``block_bytes`` or more go.
   Alignment keeps to one order and to lines that tell places apart; what it
   leaves of the runs that both sides hold (blocks in another order, repeated
   lines) is aligned run by run.
4. So a line goes exactly if it lies in a run of ``block_bytes`` or more that an
   earlier document holds; blank lines and everything else stay in their order.

Keys that more than a ``SHARE``-th of all links hold (at most ``SHARE`` of them)
are broadcast with their owners; all others are joined by key.
A document that very many pairs need as their earlier side is dealt in several
copies, by the number of holders of its keys (``PAIRS`` to a copy).

Defined results: null and empty texts have no lines and stay as they are; rows
with a null id come after all others; rows that agree in id and text are one
document; a document whose lines all go keeps an empty text.  Ids of any type
that has an order will do.  Columns of the user's table stay whatever their
names; where it has one called ``_lines`` or ``_deleted``, the added one gets
underscores after its name until it is new.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm._names import free
from sievework.session import cut

#: Pairs that one copy of an earlier document serves.
PAIRS = 2000
SHARE = 1000


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of two sequences by patience diff, in order."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and in_b.get(x) == 1}
        anchors = increasing([(at[x], j) for j, x in enumerate(b[b0:b1], b0) if x in at])
        if not anchors:
            continue
        for (p, q), (r, s) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            open_.append((p + 1, r, q + 1, s))
        out += anchors
    return sorted(out)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs (already in order of the second) that increases in the first."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (i, _) in enumerate(pairs):
        at = bisect_left(tails, i)
        before[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(i)
            ends.append(k)
        else:
            tails[at], ends[at] = i, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def common_blocks(a: list, b: list, sizes: list[int], least: int) -> list[int]:
    """Positions in ``b`` of blocks that ``a`` holds too and that weigh ``least`` or more; ``sizes`` are those of ``b``'s lines."""
    out, block = [], []
    for i, j in [*align(a, b), (-2, -2)]:
        if block and (i != block[-1][0] + 1 or j != block[-1][1] + 1):
            if sum(sizes[y] for _, y in block) >= least:
                out += [y for _, y in block]
            block = []
        block.append((i, j))
    gone = set(out)
    if not {x for j, x in enumerate(b) if j not in gone}.isdisjoint(a):
        gone |= moved_runs(a, b, sizes, least)
    return sorted(gone)


def moved_runs(a: list, b: list, sizes: list[int], least: int) -> set[int]:
    """Positions in ``b`` that lie in a minimal run that ``a`` holds anywhere."""
    weight = dict(zip(b, sizes, strict=True))
    runs, start = set(), 0
    for i in range(len(a) + 1):
        if i == len(a) or a[i] not in weight:  # a run of both sides has none but lines of both
            if i > start:
                runs |= {tuple(a[start + p : start + q]) for p, q in minimal_runs(np.array([weight[x] for x in a[start:i]]), least)}
            start = i + 1
    return {j for p, q in minimal_runs(np.array(sizes), least) if tuple(b[p:q]) in runs for j in range(p, q)}


def _split(text: bytes) -> list[bytes]:
    return text.split(b"\n")


def minimal_runs(sizes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, past last) of the shortest runs that weigh ``least`` or more from each position onwards and back."""
    n = len(sizes)
    sums = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    past = np.searchsorted(sums, sums[:-1] + least)  # the first bound that is far enough from each start
    first = np.searchsorted(sums, sums[1:] - least, side="right") - 1  # the last bound that is, before each end
    return sorted({(i, j) for i, j in enumerate(past.tolist()) if j <= n} | {(i, j) for j, i in enumerate(first.tolist(), 1) if i >= 0})


def line_table(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """(nil, id, content, class, lines, sizes, runs) of each document that has lines; runs of one line are left out."""
    names = ["nil", "id", "content", "class", "lines", "sizes", "runs"]
    types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                rows: list[int] = []
                out: list[list] = [[] for _ in types]
                for row, text in enumerate(some.column(3).cast(pa.large_binary())):
                    lines = [x for x in map(bytes.strip, _split(text.as_py())) if x]
                    if lines:
                        hashes = np.array([digest(x) for x in lines], dtype=np.uint64).view(np.int64)
                        sizes = np.array([len(x) for x in lines], dtype=np.int32)
                        raw = hashes.tobytes()
                        runs = [digest(raw[8 * i : 8 * j]) for i, j in minimal_runs(sizes, block_bytes) if j > i + 1]
                        rows.append(row)
                        for column, x in zip(out, (xxhash.xxh3_128_hexdigest(raw), hashes, sizes, np.array(runs, dtype=np.uint64).view(np.int64)), strict=True):
                            column.append(x)
                kept = [some.column(i).take(pa.array(rows, pa.int64())) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, t) for x, t in zip(out, types, strict=True))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(text), text)
    return keyed.mapInArrow(run, f"nil boolean, id {kind}, content bigint, class string, lines array<bigint>, sizes array<int>, runs array<bigint>")


def pairs_of(reps: DataFrame, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """((rep, owner, part), (owner, parts)): which representatives are aligned with which earlier ones."""
    long = F.filter(F.zip_with("lines", "sizes", lambda h, n: F.when(n >= block_bytes, h)), lambda x: x.isNotNull())
    links = reps.select("rep", F.explode(F.array_distinct(F.concat(long, "runs"))).alias("key"))
    owners = cut(links.groupBy("key").agg(F.min("rep").alias("owner"), F.count("*").alias("n")).where("n > 1"))
    most = (owners.agg(F.sum("n")).first()[0] or 0) / SHARE
    hot, rest = F.broadcast(owners.where(F.col("n") > most)), owners.where(F.col("n") <= most)  # at most SHARE of the first
    met = links.join(hot, "key").unionByName(links.join(hot.select("key"), "key", "left_anti").join(rest, "key"))
    parts = F.ceil(F.col("n") / F.lit(PAIRS)).cast("int")
    pairs = met.where(F.col("rep") != F.col("owner")).groupBy("rep", "owner").agg(F.max(parts).alias("parts"))
    pairs = cut(pairs.select("rep", "owner", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part")))
    return pairs, pairs.groupBy("owner").agg((F.max("part") + 1).alias("parts"))


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 40) -> DataFrame:
    """(id, content, gone): positions among a document's lines that aren't blank; an empty array stands for all of them."""
    table = cut(line_table(docs, id_col, text_col, block_bytes))
    order = F.struct("nil", "id", "content")
    reps = cut(table.groupBy("class").agg(F.min(order).alias("rep"), F.first("lines").alias("lines"), F.first("sizes").alias("sizes"), F.first("runs").alias("runs")))
    pairs, parts = pairs_of(reps, block_bytes)
    earlier = parts.join(reps.select(F.col("rep").alias("owner"), F.col("lines").alias("before")), "owner")
    earlier = earlier.select("owner", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "before")
    both = pairs.join(reps.select("rep", "lines", "sizes"), "rep").join(earlier, ["owner", "part"]).select("rep.id", "rep.content", "before", "lines", "sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                rows, gone = [], []
                for k, (a, b, n) in enumerate(zip(*(some.column(i).to_pylist() for i in (2, 3, 4)), strict=True)):
                    if found := common_blocks(a, b, n, block_bytes):
                        rows.append(k)
                        gone.append(found)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(rows, pa.int64())), some.column(1).take(pa.array(rows, pa.int64())), pa.array(gone, pa.list_(pa.int32()))], ["id", "content", "gone"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = both.mapInArrow(run, f"id {kind}, content bigint, gone array<int>")
    # of one document's own lines: every pair's positions become one set before they meet
    found = found.select("id", "content", F.explode("gone").alias("line")).groupBy("id", "content").agg(F.collect_set("line").alias("gone"))
    weight = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda acc, n: acc + n)
    copies = table.select("nil", "id", "content", "class").distinct().join(reps.where(weight >= block_bytes).select("class", "rep"), "class").where(order != F.col("rep"))
    return found.unionByName(copies.select("id", "content", F.array().cast("array<int>").alias("gone")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 40) -> DataFrame:
    """``docs`` without the deleted lines, all columns, and ``_lines`` and ``_deleted``: lines that aren't blank, and how many went."""
    # a class's representative can be in found; a copy never is, as only representatives are paired
    key, content, positions = (free(docs, x) for x in ("_id", "_content", "_gone"))
    gone = deletions(docs, id_col, text_col, block_bytes).select(F.col("id").alias(key), F.col("content").alias(content), F.col("gone").alias(positions))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(text) == F.col(content)), "left").drop(key, content)
    at = docs.columns.index(text_col)
    added = [free(docs, x) for x in ("_lines", "_deleted")]
    width, names = len(docs.columns), [*docs.columns, *added]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, T.LongType()) for x in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, deleted = [], [], []
            for text, gone in zip(batch.column(at), batch.column(width), strict=True):
                raw = text.as_py()
                lines = _split(raw.encode()) if raw else []
                solid = [k for k, x in enumerate(lines) if x.strip()]
                counts.append(len(solid))
                if not gone.is_valid:
                    texts.append(raw)
                    deleted.append(0)
                    continue
                positions = gone.as_py() or range(len(solid))
                out = {solid[k] for k in positions}
                deleted.append(len(out))
                left = [x for k, x in enumerate(lines) if k not in out]
                texts.append("" if len(out) == len(solid) else b"\n".join(left).decode())
            columns = [batch.column(i) for i in range(width)]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(deleted, pa.int64())], names)

    return joined.mapInArrow(run, schema)
