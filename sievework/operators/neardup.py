"""Near-duplicate prose by token sets, openings and templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.session import cut_round

MAP_WORDS = 8
CELLS = 1 << 21
CROWD = 1 << 13
SLACK = 1e-9


def meetings(batches: Iterator[pa.RecordBatch], key: str, size: str, own: str | None, share: float, asks: str | None = None) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, i, j): places in ``rows`` of two of one ``key`` and different ``own`` (64-bit integers) whose sizes are near enough; ``rows``, sorted by key and size, follow one another.

    Of a pair the smaller size is ``share`` of the larger one or more, so what
    is held of the batches before is the last key's rows of such sizes.  Pairs
    of the ``own`` that most rows of a key have are not even made; without a
    column of that name all rows differ.  ``asks``: whether a row may be the
    smaller one of a pair.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        some = pa.Table.from_batches([batch])
        old = 0 if held is None else held.num_rows
        rows = some if held is None else pa.concat_tables([held, some]).combine_chunks()
        keys, n = rows[key].to_numpy(), rows[size].to_numpy()
        group = np.cumsum(np.append(False, keys[1:] != keys[:-1])).astype(np.int64)
        low = np.searchsorted((group << 32) + n, (group << 32) + np.ceil(n * share - SLACK).astype(np.int64))
        new, may = np.arange(old, len(n)), np.ones(len(n), dtype=bool) if asks is None else rows[asks].to_numpy()
        who, meet = np.arange(len(n)) if own is None else rows[own].to_numpy(), [(np.flatnonzero(may), new)]
        if own is not None:
            by = np.lexsort((who, group))
            first = np.flatnonzero(np.append(True, (group[by][1:] != group[by][:-1]) | (who[by][1:] != who[by][:-1])))
            rising = np.argsort(np.diff(np.append(first, len(by))), kind="stable")
            most = np.zeros(group[-1] + 1, dtype=np.int64)
            most[group[by][first][rising]] = who[by][first][rising]  # the last one written has most rows
            few = who != most[group]
            meet = [(np.flatnonzero(may), new[few[new]]), (np.flatnonzero(may & few), new[~few[new]])]
        for places, js in meet:
            a, b = np.searchsorted(places, low[js]), np.searchsorted(places, js)
            ends = np.cumsum(b - a)
            at = 0
            while at < len(js):  # a few million pairs at a time
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000)))
                width = (b - a)[at:to]
                j = np.repeat(js[at:to], width)
                i = places[np.arange(len(j)) + np.repeat(a[at:to] - (np.cumsum(width) - width), width)]
                other = who[i] != who[j]
                if other.any():
                    yield rows, i[other], j[other]
                at = to
        held = rows.slice(int(low[-1]))


def exact_groups(docs: DataFrame, id_col: str, key: Column) -> DataFrame:
    """(key_hash, n, first) of keys that several rows share."""
    return docs.groupBy(F.sha2(key, 256).alias("key_hash")).agg(F.count("*").alias("n"), F.min(id_col).alias("first")).where("n > 1")


def _token_rows(docs: DataFrame, id_col: str, tokens: Column, least: int) -> tuple[DataFrame, DataFrame]:
    """((id, tokens, h, n), (h, n, class_id)) of the rows of ``least`` tokens or more; tokens are 64-bit hashes, which a Parquet table writes once each."""
    hashed = F.sort_array(F.array_distinct(F.transform(tokens, lambda w: F.xxhash64(w))))
    # short sets go after the cut: a filter before it would have every text cut into words twice
    t = cut_round(docs.select(F.col(id_col).alias("id"), hashed.alias("tokens"))).where(F.size("tokens") >= least).withColumn("h", F.xxhash64("tokens")).withColumn("n", F.size("tokens"))
    return t, t.groupBy("h", "n").agg(F.min("id").alias("class_id"))


def token_classes(docs: DataFrame, id_col: str, tokens: Column, least: int) -> DataFrame:
    """(id, class_id, tokens): rows of one and the same token set form a class named by its smallest id; tokens are 64-bit hashes."""
    t, first = _token_rows(docs, id_col, tokens, least)
    return t.join(first, ["h", "n"]).select("id", "class_id", "tokens")


def token_representatives(docs: DataFrame, id_col: str, tokens: Column, least: int) -> DataFrame:
    """The rows of ``token_classes`` that name a class; the tokens of the others don't travel."""
    t, first = _token_rows(docs, id_col, tokens, least)
    copies = cut_round(t.select("id", "h", "n").join(first, ["h", "n"]).where("id <> class_id").select("id"))
    return t.where("id is not null").join(copies, "id", "left_anti").select("id", F.col("id").alias("class_id"), "tokens")


def _counts(arrays: DataFrame) -> np.ndarray:
    """How often the tokens of each of ``CELLS`` cells stand in the one column of ``arrays``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False) & (CELLS - 1), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    out = np.zeros(CELLS, dtype=np.int64)
    found = arrays.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most CELLS rows
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def _ordered(reps: DataFrame, words: int = MAP_WORDS) -> DataFrame:
    """(id, set, n, b0, …) of ``reps`` (id, tokens): tokens in order of rarity, and ``words`` words of 64 bits, each bit the parity of the tokens that fall on it by their hash."""
    sent = reps.sparkSession.sparkContext.broadcast(_counts(reps.select("tokens")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(1)
            n = tokens.value_lengths().to_numpy(zero_copy_only=False)
            flat = tokens.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), n)
            flat = flat[np.lexsort((flat, sent.value[flat & (CELLS - 1)], row))]
            place = np.mod(flat, 64 * words)
            out = np.zeros((words, batch.num_rows), dtype=np.uint64)
            np.bitwise_xor.at(out, (place // 64, row), np.uint64(1) << (place % 64).astype(np.uint64))
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), sets, pa.array(n.astype(np.int32)), *(pa.array(w.view(np.int64)) for w in out)], ["id", "set", "n", *bits])

    bits = [f"b{k}" for k in range(words)]
    kind = reps.schema["id"].dataType.simpleString()
    return reps.select("id", "tokens").mapInArrow(run, f"id {kind}, set array<bigint>, n int, " + ", ".join(f"{b} bigint" for b in bits))


def _times(n: Column, share: float) -> Column:
    """How many keys a set has in common with any that is like it and not shorter: more for larger sets, of which many have one token in common."""
    return F.greatest(F.lit(1), F.least(1 + F.floor(n / 32), F.lit(8), F.ceil(n * F.lit(share) - F.lit(SLACK)) - 1)).cast("int")


def _met_heads(sets: DataFrame, share: float, crowd: int = CROWD) -> DataFrame:
    """``sets`` (id, set, n, b0, …) with the keys under which they may meet: (token, size, room, asks).

    A set's first ``n - ceil(share n) + times`` tokens are its keys (``_times``), but
    for those that no other set may have among its own.  One that more than ``crowd`` sets have
    gives way to its pairs with the tokens behind it, one place further: sets
    that have more than one token in common share the first two of these.
    ``size``: the step of the set's size, where ``share`` of a size is at most one
    step below; ``room``: how many tokens can be shared from there on; ``asks``:
    a key of the shorter set of a pair, too.
    """
    step = max(-np.log(share), 0.05) * (1 + 1e-6)
    n = F.col("n")
    least = F.ceil(n * F.lit(share) - F.lit(SLACK)).cast("int")
    times = _times(n, share)
    short = (n - F.ceil(n * F.lit(2 * share / (1 + share)) - F.lit(SLACK)) + times).cast("int")
    bits = [c for c in sets.columns if c not in ("id", "set", "n")]
    firsts = sets.select("id", "n", *bits, least.alias("least"), short.alias("short"), F.slice("set", F.lit(1), n - least + times + 1).alias("heads"), times.alias("times"))
    sent = sets.sparkSession.sparkContext.broadcast(_counts(firsts.select(F.slice("heads", F.lit(1), n - F.col("least") + F.col("times")).alias("heads"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 2000) for b in batches for i in range(0, b.num_rows, 2000)):
            n, least, short, times = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "least", "short", "times"))
            held = batch.column(batch.schema.get_field_index("heads"))
            ends = np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))
            flat, most = held.flatten().to_numpy(zero_copy_only=False), n - least + times
            row = np.repeat(np.arange(batch.num_rows), most)
            at = np.arange(len(row)) - np.repeat(np.cumsum(most) - most, most)
            start = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            token = flat[start[row] + at]
            count = sent.value[token & (CELLS - 1)]
            one = np.flatnonzero((count > 1) & ((count <= crowd) | (least[row] < 2)))
            many = np.flatnonzero(count > crowd)
            behind = np.minimum(most[row[many]] + 1, n[row[many]]) - 1 - at[many]
            i = np.repeat(many, behind)
            next_at = at[i] + 1 + np.arange(len(i)) - np.repeat(np.cumsum(behind) - behind, behind)
            pair = token[i] * np.int64(-7046029254386353131) + flat[start[row[i]] + next_at]
            rows = np.concatenate([row[one], row[i]])
            keys = np.concatenate([token[one], pair ^ (pair >> 29)])
            room = np.concatenate([n[row[one]] - at[one], n[row[i]] - next_at + 1])
            asks = np.concatenate([at[one] < short[row[one]], (at[i] < short[row[i]]) & (next_at <= short[row[i]])])
            size = np.floor(np.log(n[rows]) / step).astype(np.int32)
            taken = batch.select(["id", "n", *bits]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(size), pa.array(room.astype(np.int32)), pa.array(asks), pa.array(keys)], ["id", "n", *bits, "size", "room", "asks", "token"])

    kind = sets.schema["id"].dataType.simpleString()
    return firsts.mapInArrow(run, f"id {kind}, n int, " + "".join(f"{b} bigint, " for b in bits) + "size int, room int, asks boolean, token bigint")


def jaccard_pairs(classes: DataFrame, threshold: float, words: int = MAP_WORDS, crowd: int = CROWD) -> DataFrame:
    """(left, right, common, jaccard) of class representatives with Jaccard >= threshold; exact.

    Tokens are put in order of rarity, roughly: any one order would do, so a
    sketch of ``CELLS`` counts gives it (16 MB at most).  Two sets that reach
    the threshold share a token among the first ``n - ceil(t n) + 1`` of the
    longer and the first ``n - ceil(2t/(1+t) n) + 1`` of the shorter one, and
    the first token that they share leaves room for the overlap that the
    threshold asks for.  They meet under that token, in order of their sizes, so a
    row for each token of a set is shuffled once and meets those before it; under
    a token that more than ``crowd`` sets begin with they meet by the first two
    that they share, so what a set meets doesn't follow the number of sets.  Long
    sets have a few keys more and must meet under several of them (``_times``), as
    unlike ones do under one or two.  A map of ``words`` words of
    parities goes along: every bit in which two maps differ stands for a token
    that only one side has, so it bounds the overlap from above where the two
    meet.  Only pairs that pass are counted in full.  A token that no other set
    has among its first ones meets nothing and is left at home, which a second
    sketch of counts tells.
    """
    slack, share = SLACK, threshold / (1 + threshold)
    sets = cut_round(_ordered(classes.where("id = class_id").select("id", "tokens"), words))
    met = _met_heads(sets, threshold, crowd)
    bits = [f"b{k}" for k in range(words)]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, i, j in meetings(batches, "token", "n", None, threshold, "asks"):
            n, room, times = (rows[c].to_numpy().astype(np.int64) for c in ("n", "room", "times"))
            # the last of the keys that they must share has the others before it
            good = np.minimum(room[i], room[j]) >= (n[i] + n[j]) * share - slack - (times[i] - 1)
            i, j = i[good], j[good]
            differ = np.zeros(len(i), dtype=np.int64)
            for c in bits:
                word = rows[c].to_numpy().view(np.uint64)
                differ += np.bitwise_count(word[i] ^ word[j])
                good = n[i] + n[j] - differ >= (n[i] + n[j]) * 2 * share - slack
                i, j, differ = i[good], j[good], differ[good]
            if len(i):
                a, b = (rows["id"].combine_chunks().take(pa.array(x)) for x in (i, j))
                yield pa.RecordBatch.from_arrays([a, b, pa.array(times[i].astype(np.int32))], ["a", "b", "times"])

    kind = sets.schema["id"].dataType.simpleString()
    met = met.drop("size").withColumn("times", _times(F.col("n"), threshold)).repartition("token").sortWithinPartitions("token", "n")
    found = met.mapInArrow(meet, f"a {kind}, b {kind}, times int").where("a <> b")
    often = found.groupBy(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).agg(F.count("*").alias("n"), F.min("times").alias("times")).where("n >= times")
    pairs = cut_round(often.select("left", "right"))
    sets = sets.select("id", "set").join(pairs.select(F.col("left").alias("id")).union(pairs.select("right")).distinct(), "id", "left_semi")
    full = pairs.join(sets.select(F.col("id").alias("left"), F.col("set").alias("ls")), "left").join(sets.select(F.col("id").alias("right"), F.col("set").alias("rs")), "right")
    common = F.size(F.array_intersect("ls", "rs"))
    out = full.select("left", "right", common.alias("common"), (common / (F.size("ls") + F.size("rs") - common)).alias("jaccard"))
    return out.where(F.col("jaccard") >= threshold - slack)


def openings(docs: DataFrame, id_col: str, tokens: Column, n: int, least: int) -> DataFrame:
    """D3: (opening, n, first) of first-``n``-token openings that ``least`` rows share."""
    o = docs.select(id_col, F.array_join(F.slice(tokens, 1, n), " ").alias("opening"), F.size(tokens).alias("size")).where(F.col("size") >= n)
    return o.groupBy("opening").agg(F.count("*").alias("n"), F.min(id_col).alias("first")).where(F.col("n") >= least)


def template(text: Column, names: list[str]) -> Column:
    """Text with numbers and known names (longest first) as placeholders."""
    c = F.lower(text)
    for name in sorted(names, key=lambda s: (-len(s), s)):
        c = F.replace(c, F.lit(name.lower()), F.lit("{name}"))
    return F.regexp_replace(c, "[0-9]+", "{n}")


def similarity_key(title: Column, tail: str) -> Column:
    """A title without its variant suffix and trailing noun phrase."""
    c = F.regexp_replace(F.lower(title), r"\s*:\s*design\s+[0-9]+$", "")
    return F.trim(F.regexp_replace(c, rf"\s+{tail}$", ""))
