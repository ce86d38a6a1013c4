"""Quality scores from a linear model on naive-Bayes-scaled n-gram indicators.

Features are the presence of hashed n-grams: runs of two to four bytes, single
words and word pairs, and which tenth of the word pairs repeat one word and
which power of two the word count reaches.  Each is scaled by the log ratio of its smoothed rates in
the two classes, rows are brought to unit length, and a linear hinge-loss model
is fitted by dual coordinate descent.  A sigmoid fitted on rows kept out of
that fit turns margins into probabilities under the labels' true class shares.

Fitting uses a bounded, documented sample of labelled rows (``per_class`` rows
and ``most_features`` indicators of each class, by hash order) and runs in one
task of bounded memory; class shares are counted over all labels.  Scoring
reads every whole text in one pass without a shuffle; what is sent to the
executors is one weight per bucket.

Defined results: null and empty texts, and those of white space alone, have next to no features and get the score of
the bias alone; a label table without one of the classes gives every row that
class's share (or 0.5 without any label); a row with several labels counts as
the highest of them.  Ids of any type will do; ``keep_good`` gives all columns
back under their names, whatever these are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm._words import Slice, mix, slices

BITS = 18
BYTE_RUNS = (2, 3, 4)


def _bucket(x: np.ndarray, salt: int) -> np.ndarray:
    return (mix(x, salt) >> np.uint64(64 - BITS)).astype(np.int32)


def indicators(s: Slice, bounds: np.ndarray, seen: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct feature buckets of each document of a slice; ``seen`` is scratch space of 2**BITS."""
    runs, x = [], s.raw.astype(np.uint64)
    for k in range(1, max(BYTE_RUNS)):
        x = x[:-1] << np.uint64(8) | s.raw[k:] if len(x) else x
        if k + 1 in BYTE_RUNS:
            runs.append((k + 1, _bucket(x, k)))
    words = s.word_hashes()
    singles = _bucket(words, 21)
    pairs = _bucket(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:], 22) if len(words) > 1 else singles[:0]
    again = np.concatenate([[0], np.cumsum(words[1:] == words[:-1])]) if len(words) else np.zeros(1, np.int64)
    shapes = [_bucket(np.arange(64, dtype=np.uint64), 23), _bucket(np.arange(64, dtype=np.uint64), 24)]
    for i in range(s.last - s.first):
        a, b = int(bounds[i]), int(bounds[i + 1])
        u, v = int(s.word_from[i]), int(s.word_from[i + 1])
        shape = []
        if v > u:
            same = int(again[v - 1] - again[u])
            shape = [shapes[0][(v - u).bit_length()], shapes[1][-(-10 * same // (v - u))]]
        all_ = np.concatenate([*(h[a : max(a, b - n + 1)] for n, h in runs), singles[u:v], pairs[u : max(u, v - 1)], np.array(shape, dtype=np.int32)])
        at = np.arange(len(all_), dtype=np.int32)
        seen[all_] = at
        yield all_[seen[all_] == at]


def _documents(column: pa.Array) -> Iterator[np.ndarray]:
    from sievework.llm._words import buffers

    _, bounds = buffers(column)
    seen = np.zeros(1 << BITS, dtype=np.int32)
    for s in slices(column):
        yield from indicators(s, bounds[s.first : s.last + 1] - bounds[s.first], seen)


@dataclass
class Model:
    weights: np.ndarray  # one per bucket, ratio and hinge weight multiplied
    bias: float
    scale: np.ndarray  # the squared ratios: rows are brought to unit length by them
    slope: float
    offset: float

    def margin(self, buckets: np.ndarray) -> float:
        if not len(buckets):
            return self.bias
        return float(self.weights[buckets].sum() / max(np.sqrt(self.scale[buckets].sum()), 1e-9)) + self.bias

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -35, 35)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """The log ratio of a bucket's smoothed rate in class 1 to that in class 0."""
    counts = np.full((2, 1 << BITS), smooth)
    for row, k in zip(rows, y, strict=True):
        counts[k, row] += 1  # a row's buckets are distinct
    held = np.bincount(y, minlength=2) + 2 * smooth
    return np.log(counts[1] / held[1]) - np.log(counts[0] / held[0])


class Scaled(Sequence):
    """Each row's ratios brought to unit length, computed when they are asked for."""

    def __init__(self, rows: list[np.ndarray], ratios: np.ndarray):
        self.rows, self.ratios = rows, ratios
        self.shrink = [1 / max(np.sqrt(float(ratios[r] @ ratios[r])), 1e-9) for r in rows]

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ratios[self.rows[i]] * self.shrink[i]


def dual_coordinate_descent(rows: list[np.ndarray], values: Sequence[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, rounds: int = 20, seed: int = 7, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + sum of cost x hinge loss, by its dual one row at a time."""
    w, bias, signs = np.zeros(size), 0.0, np.where(y == 1, 1.0, -1.0)
    alpha = np.zeros(len(rows))
    squares = np.array([float(v @ v) for v in values]) + 1.0  # the bias is a constant feature
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            own = values[i]
            slope = signs[i] * (float(w[rows[i]] @ own) + bias) - 1
            projected = min(slope, 0.0) if alpha[i] <= 0 else max(slope, 0.0) if alpha[i] >= cost[i] else slope
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - slope / squares[i], 0.0), cost[i])
                step = (new - alpha[i]) * signs[i]
                w[rows[i]] += step * own
                bias += step
                alpha[i] = new
        if worst < tolerance:
            break
    return w, bias


def sigmoid_fit(margins: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of the logistic curve through weighted margins (Newton steps, lightly damped, smoothed targets)."""
    pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    theta = np.array([1.0, np.log((pos + 1) / (neg + 1))])

    def loss(t):
        z = x @ t
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 1e-3 * t @ t)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ theta))
        grad = x.T @ (weight * (p - target)) + 2e-3 * theta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2)
        step, rate = np.linalg.solve(hess, grad), 1.0
        while rate > 1e-6 and loss(theta - rate * step) > loss(theta):
            rate /= 2
        theta = theta - rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def fit_rows(rows: list[np.ndarray], y: np.ndarray, shares: tuple[float, float], kept_out: np.ndarray, cost: float = 1.0) -> Model:
    """Fit on the rows that aren't kept out, calibrate on those that are; shares: of classes 0 and 1 in all labels."""
    if len(set(y.tolist())) < 2 or len(set(y[kept_out].tolist())) < 2:
        kept_out = np.zeros(len(y), dtype=bool)
    if len(set(y.tolist())) < 2:
        share = shares[1] / max(sum(shares), 1e-9) if sum(shares) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        zero = np.zeros(1 << BITS)
        return Model(zero, 0.0, zero, 1.0, float(np.log(share / (1 - share))))
    fit = np.flatnonzero(~kept_out)
    ratios = log_count_ratios([rows[i] for i in fit], y[fit])
    scale = ratios**2
    counts = np.bincount(y[fit], minlength=2)
    chosen = [rows[i] for i in fit]
    w, bias = dual_coordinate_descent(chosen, Scaled(chosen, ratios), y[fit], cost * len(fit) / (2 * counts[y[fit]]), 1 << BITS)
    model = Model((w * ratios).astype(np.float32), bias, scale.astype(np.float32), 1.0, 0.0)
    check = np.flatnonzero(kept_out) if kept_out.any() else fit
    margins = np.array([model.margin(rows[i]) for i in check])
    have = np.bincount(y[check], minlength=2)
    weight = np.array([shares[k] / max(sum(shares), 1e-9) * len(check) / have[k] for k in y[check]])
    model.slope, model.offset = sigmoid_fit(margins, y[check], weight)
    return model


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2000, most_features: int = 6_000_000) -> Model:
    """Fit on at most ``per_class`` labelled rows of each class and at most ``most_features`` indicators of each.

    Rows come in hash order; one that would exceed the indicators of its class is left out of the fit (a row has at
    most 2**BITS).  The fit runs in one task, which holds 4 bytes an indicator; only the model (2 MB) reaches the
    driver.  Rows for which ``held_out`` holds are never read.
    """
    key = F.col(id_col).cast("string")
    allowed = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(key.alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    counts = {r._y: float(r.n) for r in allowed.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    shares = (counts.get(0, 0.0), counts.get(1, 0.0))
    order = F.xxhash64("_id", F.lit(5))
    sample = allowed.where("_y = 0").orderBy(order, "_id").limit(per_class).unionByName(allowed.where("_y = 1").orderBy(order, "_id").limit(per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.astype(np.int32).tobytes() for x in _documents(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(found, pa.binary())], ["h", "y", "kept_out", "buckets"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y, out, room = [], [], [], [most_features] * 2
        for batch in batches:
            for k, o, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                x = np.frombuffer(raw.as_py(), dtype=np.int32)
                if len(x) <= room[k]:
                    room[k] -= len(x)
                    rows.append(x)
                    y.append(k)
                    out.append(o)
        m = fit_rows(rows, np.array(y, dtype=np.int64), shares, np.array(out, dtype=bool))
        data = [[m.weights.astype(np.float32).tobytes()], [m.scale.astype(np.float32).tobytes()], [float(m.bias)], [float(m.slope)], [float(m.offset)]]
        types = [pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, types, strict=True)], ["weights", "scale", "bias", "slope", "offset"])

    texts = docs.where(F.col(id_col).isNotNull()).select(key.alias("_key"), F.col(text_col).cast("string").alias("_text"))
    few = texts.join(F.broadcast(sample), F.col("_key") == F.col("_id"))  # 2 x per_class ids
    read = few.select(F.xxhash64("_id", "_text").alias("h"), "_y", (F.pmod(F.xxhash64("_id", F.lit(9)), F.lit(4)) == 0).alias("o"), "_text")
    seen = read.mapInArrow(run, "h bigint, y int, kept_out boolean, buckets binary").repartition(1).sortWithinPartitions("h", "buckets")
    r = seen.mapInArrow(solve, "weights binary, scale binary, bias double, slope double, offset double").first()
    if r is None:  # nothing reached the task, so it never ran
        return fit_rows([], np.zeros(0, dtype=np.int64), shares, np.zeros(0, dtype=bool))
    return Model(np.frombuffer(r.weights, dtype=np.float32), r.bias, np.frombuffer(r.scale, dtype=np.float32), r.slope, r.offset)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of ``docs``; the model goes along as a fixed 2 MB."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            margins = np.array([m.margin(x) for x in _documents(batch.column(1))], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.score(margins), pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(run, f"id {kind}, score double")


def keep_good(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, all columns, in one pass without a join."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            text = batch.column(at)
            scores = m.score(np.array([m.margin(x) for x in _documents(text)], dtype=np.float64))
            yield batch.filter(pa.array(scores >= least))

    return docs.mapInArrow(run, docs.schema)
