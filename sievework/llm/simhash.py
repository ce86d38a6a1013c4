"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A text's fingerprint has bit b set if over half of its 3-word shingles' XXH64
values have it set.  Fingerprints link at two or fewer differing bits:

* The 64 bits fall into segments of 21, 21 and 22 bits.  With two errors over
  three segments one of the ordered segment pairs (0,1), (1,2), (2,0) has no
  error in its first and at most one in its second segment.
* The second segment is decoded with the binary Golay code (23, 12, 7) to the
  indices of all codewords within four bits (one to six).  Words one bit apart
  always share an index, so the first segment with any index of the second is
  a key that the two fingerprints share.
* Within a key, fingerprints meet at the centres one bit away: two words are
  two or fewer bits apart exactly if their radius-one balls meet.  A centre has
  at most 65 different fingerprints, so a bucket of any size costs work in
  proportion to its rows and never all of its pairs.  Each link is verified by
  its bit count.

Defined results: a null or empty text has fingerprint zero and links like any
other; rows with a null ``doc_id`` are kept with a null component unless their
fingerprint's class has an id; repeated rows give repeated rows.  Ids of any
type that has an order will do; only the id and text columns are read, and
``keep_one`` gives all columns back, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm._words import LOWER_TABLE
from sievework.operators.graph import connected_components
from sievework.session import cut

SEED = 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit and width
#: The Golay code's generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 (fixed value).
GENERATOR = 0b110001110101


def fingerprint(text: bytes, width: int = 3) -> int:
    """The fingerprint of one UTF-8 text as a signed 64-bit integer."""
    words = text.translate(LOWER_TABLE).split()
    if not words:
        return 0
    if len(words) <= width:
        grams = [b" ".join(words)]
        hashes = np.array([xxhash.xxh64_intdigest(grams[0], SEED)], dtype=np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = (ends[:-width] - np.fromiter(map(len, words[:-width]), dtype=np.int64, count=len(words) - width) - 1).tolist()
        starts.append(int(ends[-width]) - len(words[-width]) - 1)
        stops = (ends[width - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    on = votes * 2 > len(hashes)
    return int(np.packbits(on, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) for each row of ``docs``; whole texts, one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = [fingerprint(x.as_py() or b"", width) if x.is_valid else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, fp bigint")


def _remainders() -> np.ndarray:
    """The code's syndrome of each single bit of a 23-bit word."""
    out = []
    for bit in range(23):
        x = 1 << bit
        for top in range(22, 10, -1):
            if x >> top & 1:
                x ^= GENERATOR << (top - 11)
        out.append(x)
    return np.array(out, dtype=np.int64)


def _patterns() -> np.ndarray:
    """For each syndrome the error patterns of at most four bits, -1 where there are fewer than six."""
    bits = _remainders()
    found: list[list[int]] = [[] for _ in range(2048)]
    level = [(0, 0, 0)]  # pattern, syndrome, next bit
    for weight in range(5):
        for pattern, s, _ in level:
            found[s].append(pattern)
        level = [(p | 1 << b, s ^ int(bits[b]), b + 1) for p, s, at in level for b in range(at, 23)] if weight < 4 else []
    table = np.full((2048, 6), -1, dtype=np.int64)
    for s, patterns in enumerate(found):
        table[s, : len(patterns)] = patterns
    return table


class Golay:
    """Nearest and nearby codewords of 23-bit words, vectorised."""

    def __init__(self) -> None:
        self.patterns = _patterns()
        low = np.zeros(1 << 12, dtype=np.int64)
        high = np.zeros(1 << 11, dtype=np.int64)
        for bit, r in enumerate(_remainders().tolist()):
            table = low if bit < 12 else high
            at = np.arange(len(table))
            table[at >> (bit if bit < 12 else bit - 12) & 1 == 1] ^= r
        self.low, self.high = low, high

    def indices(self, words: np.ndarray) -> np.ndarray:
        """An (n, 6) array of codeword indices within four bits, -1 where there are fewer."""
        s = self.low[words & 0xFFF] ^ self.high[words >> 12]
        e = self.patterns[s]
        return np.where(e < 0, -1, (words[:, None] ^ e) >> 11)  # the 12 message bits name the codeword


def golay_keys(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each fingerprint's keys: pair of segments, first segment, codeword index of the second."""
    words = fps.view(np.uint64)
    parts = [(words >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    rows, keys = [], []
    for pair in range(3):
        index = code.indices(parts[(pair + 1) % 3])
        key = (pair << 34 | parts[pair] << 12)[:, None] | index
        row, col = np.nonzero(index >= 0)
        rows.append(row)
        keys.append(key[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def _centre_masks() -> list[list[int]]:
    """By pair: what to flip to reach each centre (nothing, or one bit outside the pair's exact segment), signed."""
    masks = []
    for pair in range(3):
        at, width = SEGMENTS[pair]
        free = [b for b in range(64) if not at <= b < at + width]
        masks.append([0] + [(1 << b) - (1 << 64 if b == 63 else 0) for b in free])
    return masks


def links(fps: DataFrame) -> DataFrame:
    """(src, dst) edges that connect all distinct values of ``fp`` within two bits; each edge is verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(values), 20_000):
                part = values[i : i + 20_000]
                row, key = golay_keys(part, code)
                yield pa.RecordBatch.from_arrays([pa.array(part[row]), pa.array(key)], ["fp", "key"])

    keys = fps.select("fp").where("fp is not null").distinct().mapInArrow(run, "fp bigint, key bigint")
    shared = keys.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("key")
    masks = _centre_masks()
    flips = F.when(F.shiftright("key", 34) == 0, F.array(*map(F.lit, masks[0])))
    flips = flips.when(F.shiftright("key", 34) == 1, F.array(*map(F.lit, masks[1]))).otherwise(F.array(*map(F.lit, masks[2])))
    met = (
        keys.join(shared, "key")
        .select("fp", "key", F.explode(flips).alias("flip"))
        .groupBy("key", F.expr("fp ^ flip").alias("centre"))
        .agg(F.min("fp").alias("dst"), F.collect_list("fp").alias("members"))  # at most 65 by the code
        .where(F.size("members") > 1)
    )
    return (
        met.select(F.explode("members").alias("src"), "dst")
        .where("src <> dst and bit_count(src ^ dst) <= 2")
        .distinct()
    )


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): per row of ``docs`` the smallest id reachable over links."""
    fps = cut(fingerprints(docs, id_col, text_col))
    found = connected_components(links(fps))
    classes = fps.groupBy("fp").agg(F.min("id").alias("low"))
    by_fp = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    roots = by_fp.groupBy("root").agg(F.min("low").alias("component"))
    named = cut(by_fp.join(roots, "root").select("fp", "component"))
    return fps.join(named, "fp").select("id", "fp", "component")


def hex16(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: its smallest id.

    Rows with a null id stay (nothing says which of them came first); of rows
    that repeat the smallest id all stay.
    """
    kept = components(docs, id_col, text_col).where("id is null or id = component").select(F.col("id").alias("_kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept"]), "left_semi")
