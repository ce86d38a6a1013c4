"""Language-model scores of whole texts: Katz backoff over Good-Turing discounted n-gram counts.

A text's tokens are its lower-cased words and one end.  With c the number of
times an n-gram stands in the training texts and T that of its context,

    P(w | context) = r*(c) / T                      if c > 0
                     a(context) P(w | shorter one)  if c = 0 and T > 0
                     P(w | shorter one)             if T = 0

down to single words, whose probability is (c + 0.1) / (N + 0.1 (V + 1)).  r* is
the Good-Turing count (r + 1) n(r+1) / n(r) up to ``LARGE`` and takes off the
same amount from there on, so every context keeps something back; where the
counts of counts give no r* between 0 and r, n1 / (n1 + 2 n2) is taken off.
a(context) is what the context keeps back over what the shorter context gives to
the words not seen after this one, so each context's probabilities sum to one.
A word seen after a context was seen after the shorter one too, so this takes no
backing off and each n-gram's share of it is known from its own counts.

1. Each task cuts its documents into chunks of ``CHUNK`` tokens, written down as
   numbers of their own words.
2. A chunk asks for each of its distinct n-grams once, with its own training
   count, in the hash range's shard.  A shard adds up the counts, answers each
   chunk in the order in which it has asked, and names one chunk the n-gram's
   owner.  A very frequent n-gram is one entry for each chunk.
3. Chunks meet their answers.  Owners add their n-grams' shares to the contexts'
   table; a document's known terms are summed at once; what is open are the
   weights a(context) of the n-grams that were not found, one row for each
   chunk and context.
4. Contexts are summed, met by the open rows, and these by the documents.

The model's tables (``contexts``, ``open``, ``documents``) are parts of one
Parquet table in the shared folder.  The driver sees the counts of counts alone.
Words and contexts are told apart by 64 bits of hash, longer n-grams by ``SPARE``
bits more than the number of tokens has.  ``order`` 2 is the default; each
order more costs about as much again in shuffled keys.

Defined results: null and empty texts have the end alone; each row is a
document, repeated ones too; a row with a null id is a training row.  Without
training rows, c, T, N and V are 0.  Ids of any type will do.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sievework.llm._words import mix, slices
from sievework.session import cut, shared_dir

CHUNK = 1_000_000
#: Bits of an n-gram's key beyond those that count the tokens: at most one n-gram in 2**SPARE shares its key with another.
SPARE = 24
SHARD = 4_000_000
LARGE = 5
ADD = 0.1
END = mix(np.array([1], dtype=np.uint64), 41)[0]
BEGIN = mix(np.arange(64, dtype=np.uint64), 42)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from zero on, by bytes of one weight and deflated."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64)


def contexts(hashes: np.ndarray, begin: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(context key, n-gram key) of every token for n = 1 .. order; ``begin`` marks each document's first token."""
    keys = hashes
    yield np.zeros(len(hashes), dtype=np.uint64), keys
    for n in range(2, order + 1):
        own = np.empty_like(keys)
        own[1:] = keys[:-1]
        own[begin] = BEGIN[n]
        keys = mix(own * np.uint64(0x9E3779B97F4A7C15) + hashes, n)
        yield own, keys


def tokens_of(words: bytes, tokens: bytes) -> np.ndarray:
    return np.frombuffer(words, dtype=np.uint64)[unpack(tokens).astype(np.int64)]


def discounted(counts_of_counts: list[int]) -> np.ndarray:
    """r* for r = 0 .. LARGE, from n(1) .. n(LARGE + 1)."""
    n = [0, *counts_of_counts]
    off = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    star = np.zeros(LARGE + 1)
    for r in range(1, LARGE + 1):
        good = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
        star[r] = good if 0 < good < r else r - off
    return star


def star_of(star: np.ndarray, c: np.ndarray) -> np.ndarray:
    small = np.minimum(c, LARGE)
    return star[small] + (c - small)


CHUNKS = "chunk bigint, n bigint, train array<boolean>, lengths array<int>, words binary, tokens binary"


def _chunks(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    kind = docs.schema[id_col].dataType
    types = [pa.int64(), pa.int64(), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(to_arrow_type(kind))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        made = 0
        hashes: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        ids: list[pa.Array] = []
        flags: list[pa.Array] = []

        def done() -> pa.RecordBatch:
            words, index, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            by = np.argsort(-times, kind="stable")
            place = np.empty(len(by), dtype=np.int64)
            place[by] = np.arange(len(by))
            row = [first + made, len(index), pa.concat_arrays(flags), np.concatenate(lengths).astype(np.int32), words[by].tobytes(), pack(place[index]), pa.concat_arrays(ids)]
            hashes.clear(), lengths.clear(), ids.clear(), flags.clear()
            return pa.RecordBatch.from_arrays([_one(x, t) for x, t in zip(row, types, strict=True)], ["chunk", "n", "train", "lengths", "words", "tokens", "ids"])

        held = 0
        for batch in batches:
            for s in slices(batch.column(2), lower=True):
                hashes.append(np.insert(s.word_hashes(), s.word_from[1:], END))
                lengths.append(np.diff(s.word_from) + 1)
                ids.append(batch.column(0).slice(s.first, s.last - s.first))
                flags.append(batch.column(1).slice(s.first, s.last - s.first))
                held += len(hashes[-1])
                if held >= CHUNK:
                    yield done()
                    made, held = made + 1, 0
        if hashes:
            yield done()

    read = docs.select(F.col(id_col), train, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return read.mapInArrow(run, f"{CHUNKS}, ids array<{kind.simpleString()}>")


def _one(x, kind: pa.DataType) -> pa.Array:
    """A column of one row."""
    if pa.types.is_list(kind):
        return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind.value_type)).cast(kind)
    return pa.array([x], kind)


def _learns(lengths, train) -> np.ndarray:
    return np.repeat(np.array(train, dtype=bool), lengths)


def _begins(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(int(lengths.sum()), dtype=bool)
    out[np.cumsum(lengths) - lengths] = True
    return out


def _short(keys: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The keys of words as they are, those of longer n-grams with ``bits`` bits."""
    return keys if n == 1 else keys >> np.uint64(64 - bits)


def _asks(chunks: DataFrame, order: int, shards: int, bits: int) -> DataFrame:
    """(order, shard, chunk, keys, counts): a chunk's distinct n-grams in a shard's range and its training count of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = {n: np.array([(i << (64 if n == 1 else bits)) // shards for i in range(1, shards)], dtype=np.uint64) for n in range(1, order + 1)}
        for batch in batches:
            for chunk, train, lengths, words, tokens in zip(*(batch.column(i) for i in range(5)), strict=True):
                length = lengths.values.to_numpy()
                learns, begin = _learns(length, train.as_py()), _begins(length)
                for n, (_, keys) in enumerate(contexts(tokens_of(words.as_py(), tokens.as_py()), begin, order), 1):
                    own, index = np.unique(_short(keys, n, bits), return_inverse=True)
                    count = np.bincount(index[learns], minlength=len(own))
                    cuts = [0, *np.searchsorted(own, bounds[n]).tolist(), len(own)]
                    full = [k for k in range(shards) if cuts[k] < cuts[k + 1]]
                    parts = [slice(cuts[k], cuts[k + 1]) for k in full]
                    columns = [pa.array([n] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array([chunk.as_py()] * len(full), pa.int64())]
                    packed = [pa.array([pack(np.diff(own[p], prepend=np.uint64(0))) for p in parts], pa.binary()), pa.array([pack(count[p]) for p in parts], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns + packed, ["order", "shard", "chunk", "keys", "counts"])

    return chunks.select("chunk", "train", "lengths", "words", "tokens").mapInArrow(run, "order int, shard int, chunk bigint, keys binary, counts binary")


def _answers(asks: DataFrame, parts: int) -> DataFrame:
    """(chunk, order, shard, found, stats): twice the count, and one for the owner, of each n-gram asked for; a shard's N, V and counts of counts in a row of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> pa.RecordBatch:
            keys = [np.cumsum(unpack(k), dtype=np.uint64) for _, k, _ in held]
            own, first, index = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            total = np.zeros(len(own), dtype=np.int64)
            np.add.at(total, index, np.concatenate([unpack(c) for _, _, c in held]).astype(np.int64))
            found = total[index] * 2
            found[first] += 1
            ends = np.cumsum([len(k) for k in keys])
            parts = [pack(found[b - len(k) : b]) for k, b in zip(keys, ends.tolist(), strict=True)]
            small = np.bincount(np.minimum(total, LARGE + 2), minlength=LARGE + 3)
            stats = [int(total.sum()), int((total > 0).sum()), *small[1 : LARGE + 2].tolist()]
            n = len(held) + 1
            columns = [pa.array([*(h[0] for h in held), None], pa.int64()), pa.array([at[0]] * n, pa.int32()), pa.array([at[1]] * n, pa.int32()), pa.array([*parts, None], pa.binary()), pa.array([None] * (n - 1) + [stats], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "order", "shard", "found", "stats"])

        for batch in batches:
            for order, shard, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if at != (order, shard):
                    if held:
                        yield done()
                    at, held = (order, shard), []
                held.append(row)
        if held:
            yield done()

    met = asks.repartition(parts, "order", "shard").sortWithinPartitions("order", "shard", "chunk")
    return met.mapInArrow(run, "chunk bigint, order int, shard int, found binary, stats array<bigint>")


OUT = "kind string, order int, key bigint, kept double, lower double, chunk bigint, doc int, docs array<int>, times array<int>, train boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _evaluate(chunks: DataFrame, answers: DataFrame, order: int, bits: int, total: int, types: int, begun: int, stars: list[np.ndarray], parts: int) -> DataFrame:
    """The rows of the model's tables, by ``kind``."""
    kind = dict(chunks.dtypes)["ids"][len("array<") : -1]
    names = [c.split()[0] for c in OUT.split(", ")] + ["id"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def rows(n: int, id_type, **given) -> pa.RecordBatch:
        columns = [given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in zip(names, [*kinds, id_type], strict=True)]
        return pa.RecordBatch.from_arrays(columns, names)

    def score(chunk: int, train, lengths, words, tokens, ids, found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        length = lengths.values.to_numpy()
        begin, doc = _begins(length), np.repeat(np.arange(len(length), dtype=np.int32), length)
        at = np.cumsum(length) - length
        before = lower = None
        levels, open_ = [], []
        for n, (context, keys) in enumerate(contexts(tokens_of(words, tokens), begin, order), 1):
            own, one, index = np.unique(_short(keys, n, bits), return_index=True, return_inverse=True)
            entry = found[n - 1].astype(np.int64)
            c = (entry >> 1)[index]
            if n == 1:
                share = (c + ADD) / (total + ADD * (types + 1))
                best, known, base = np.log10(share), c > 0, np.log10(share)
            else:
                times = np.empty_like(before)
                times[1:] = before[:-1]
                times[begin] = begun
                seen = c > 0
                share = np.where(seen, star_of(stars[n - 1], c) / np.maximum(times, 1), 0.0)
                mine = one[(entry & 1 == 1) & (entry > 1)]  # a token of each n-gram that this chunk owns
                kept = (c[mine] - star_of(stars[n - 1], c[mine])) / times[mine]
                group, of = np.unique(context[mine], return_inverse=True)
                if len(group):
                    sums = [np.bincount(of, weights=x, minlength=len(group)) for x in (kept, lower[mine])]
                    levels.append((n, group.view(np.int64), *sums))
                best = np.where(seen, np.log10(np.where(seen, share, 1.0)), best)
                # a context seen in training, but not before this word
                open_.append((n, np.flatnonzero(~seen & (times > 0)), context))
            before, lower = c, share
        id_type = ids.values.type
        for n, group, kept, low in levels:
            yield rows(len(group), id_type, kind=["contexts"] * len(group), order=[n] * len(group), key=group, kept=kept, lower=low)
        for n, some, context in open_:
            if not len(some):
                continue
            by = some[np.lexsort((doc[some], context[some]))]
            new = np.ones(len(by), dtype=bool)
            new[1:] = (context[by[1:]] != context[by[:-1]]) | (doc[by[1:]] != doc[by[:-1]])
            first = np.flatnonzero(new)
            times, key, docs = np.diff(np.append(first, len(by))), context[by[first]], doc[by[first]]
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            bounds = pa.array(np.append(heads, len(key)), pa.int32())
            listed = {"docs": pa.ListArray.from_arrays(bounds, pa.array(docs, pa.int32())), "times": pa.ListArray.from_arrays(bounds, pa.array(times, pa.int32()))}
            listed = {k: v.cast(pa.list_(pa.int32())) for k, v in listed.items()}
            yield rows(len(heads), id_type, kind=["open"] * len(heads), order=[n] * len(heads), key=key[heads].view(np.int64), chunk=[chunk] * len(heads), **listed)
        sums = {"n_known": np.add.reduceat(known.astype(np.int64), at), "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(best, at)}
        yield rows(len(length), id_type, kind=["documents"] * len(length), chunk=[chunk] * len(length), doc=np.arange(len(length)), train=train.values, n_tokens=length, id=ids.values, **sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, found = None, None, []
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(9)), strict=True):
                chunk, n = row[0].as_py(), row[1].as_py()
                if chunk != at:
                    if own:
                        yield from score(at, *own, [np.concatenate(x) for x in found])
                    at, found = chunk, [[] for _ in range(order)]
                if n:
                    found[n - 1].append(unpack(row[3].as_py()))
                else:
                    own = (row[4], row[5], row[6].as_py(), row[7].as_py(), row[8])
        if own:
            yield from score(at, *own, [np.concatenate(x) for x in found])

    zero, none = F.lit(0), F.lit(None)
    a = chunks.select("chunk", zero.alias("order"), zero.alias("shard"), none.cast("binary").alias("found"), "train", "lengths", "words", "tokens", "ids")
    b = answers.select("chunk", "order", "shard", "found", *(none.cast(dict(a.dtypes)[c]).alias(c) for c in a.columns[4:]))
    met = a.unionByName(b).repartition(parts, "chunk").sortWithinPartitions("chunk", "order", "shard")
    return met.mapInArrow(run, f"{OUT}, id {kind}")


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of each row; the model learns from the rows of which ``train`` is true."""
    spark = docs.sparkSession
    chunks = cut(_chunks(docs, id_col, text_col, F.coalesce(train, F.lit(True))))
    begun = F.size(F.filter("train", lambda x: x)).cast("bigint")
    n, begun = chunks.agg(F.sum("n"), F.sum(begun)).first()
    shards = max(1, -(-(n or 0) // SHARD), min(64, (n or 0) // 250_000))
    bits = min(64, SPARE + int(n or 0).bit_length())
    parts = max(2 * spark.sparkContext.defaultParallelism, (n or 0) // (4 * CHUNK))  # a task has a few chunks, or shards, however long the corpus
    answers = cut(_answers(_asks(chunks, order, shards, bits), parts))
    sums = answers.where("stats is not null").select("order", F.posexplode("stats")).groupBy("order", "pos").agg(F.sum("col").alias("n")).collect()
    stats = {(r.order, r.pos): r.n for r in sums}
    stars = [discounted([stats.get((k, 2 + r), 0) for r in range(LARGE + 1)]) for k in range(1, order + 1)]
    total, types = stats.get((1, 0), 0), stats.get((1, 1), 0)
    at = f"{shared_dir(spark)}/katz-{uuid.uuid4().hex}"
    model = _evaluate(chunks, answers.where("stats is null").drop("stats"), order, bits, total, types, begun or 0, stars, parts)
    model.write.partitionBy("kind").parquet(at)
    kind = docs.schema[id_col].dataType.simpleString()
    model = spark.read.schema(f"{OUT}, id {kind}").parquet(at)
    weights = model.where("kind = 'contexts'").groupBy("order", "key").agg((F.sum("kept") / (1 - F.sum("lower"))).alias("weight"))
    open_ = model.where("kind = 'open'").select("order", "key", "chunk", "docs", "times")
    shares = open_.join(weights, ["order", "key"]).select("chunk", F.explode(F.arrays_zip("docs", "times")).alias("x"), F.log10("weight").alias("each"))
    shares = shares.groupBy("chunk", F.col("x.docs").alias("doc")).agg(F.sum(F.col("each") * F.col("x.times")).alias("more"))
    rows = model.where("kind = 'documents'").select("id", "chunk", "doc", "train", "n_tokens", "n_known", "base_score", "score")
    met = rows.join(shares, ["chunk", "doc"], "left")
    return met.select("id", "train", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
