from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa

from sievework.llm import quality
from tests.llm.helpers import awkward, documents


def test_indicators_are_distinct_and_stay_inside_documents():
    texts = ["ab ab", "", None, "b", "ab ab ab ab", "é" * 3]
    alone = [next(iter(quality._documents(pa.array([t], pa.string())))) for t in texts]
    together = list(quality._documents(pa.array(texts, pa.string())))
    for a, b in zip(alone, together, strict=True):
        assert sorted(a.tolist()) == sorted(b.tolist()) and len(set(a.tolist())) == len(a)
    assert len(together[1]) == len(together[2]) == 0
    # bytes: ab,b_,_a / ab_,b_a,_ab / ab_a,b_ab; words: ab; pair: ab ab; two shapes
    assert len(together[0]) == 3 + 3 + 2 + 1 + 1 + 2


def test_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = (x @ [1, -2, 0.5, 0, 1] + 0.3 * rng.normal(size=60) > 0.2).astype(int)
    rows, values, cost = [np.arange(5)] * 60, list(x), np.full(60, 0.5)
    w, b = quality.dual_coordinate_descent(rows, values, y, cost, 5, rounds=3000, tolerance=1e-9)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - np.where(y == 1, 1, -1) * (x @ w + b))).sum()

    best = loss(w, b)
    for _ in range(3000):
        assert loss(w + rng.normal(size=5) * 0.02, b + rng.normal() * 0.02) >= best - 1e-6


def made(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = [rng.choice(["the", "sun", "rises", "over", "hills", "and", "people", "walk"]) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(w if good else w.upper() + "!!" for w in words)))
        labels.append((i, int(good), None))
    return rows, labels


def test_held_out_accuracy_and_calibration(spark):
    rows, labels = made(800, 1)
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = documents(spark, rows)
    model = quality.fit(docs, labels, per_class=300)
    scores = {r.id: r.score for r in quality.score(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in scores if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100
    assert np.mean([(scores[i] >= 0.5) == truth[i] for i in held]) > 0.97
    assert abs(np.mean([scores[i] for i in held]) - np.mean([truth[i] for i in held])) < 0.05


def test_held_out_labels_are_never_used(spark):
    rows, labels = made(300, 2)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    kind = "doc_id bigint, quality int, toxic int"
    docs = documents(spark, rows)
    a = quality.fit(docs, spark.createDataFrame(labels, kind))
    b = quality.fit(docs, spark.createDataFrame(flipped, kind))
    assert (a.weights == b.weights).all() and (a.slope, a.offset) == (b.slope, b.offset)


def test_awkward_rows_and_missing_classes(spark):
    docs = documents(spark, awkward())
    kind = "doc_id bigint, quality int, toxic int"
    for labels in ([], [(4, 1, 0), (5, 1, 0)], [(4, 1, 0), (5, 0, 0), (5, None, 0), (None, 1, 1), (8, 0, 0), (9, 1, 0)]):
        model = quality.fit(docs, spark.createDataFrame(labels, kind))
        got = quality.score(docs.withColumnRenamed("source", "score"), model).collect()
        assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.id in (1, 2)}) == 1
        assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(documents(spark, []), model).count() == 0


def plain_buckets(text):
    """The features of one text by their definition, one at a time."""
    def bucket(x, salt):
        return int(quality._bucket(np.array([x], dtype=np.uint64), salt)[0])

    def word_hash(w):
        return int(next(iter(quality.slices(pa.array([w], pa.string())))).word_hashes()[0])

    raw = (text or "").encode()
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    hashes = [word_hash(w) for w in words]
    out = {bucket(int.from_bytes(raw[i : i + n], "big"), n - 1) for n in (2, 3, 4) for i in range(len(raw) - n + 1)}
    out |= {bucket(h, 21) for h in hashes} | {bucket((a * 0x9E3779B97F4A7C15 + b) % (1 << 64), 22) for a, b in zip(hashes, hashes[1:])}
    if words:
        same = sum(a == b for a, b in zip(words, words[1:]))
        out |= {bucket(len(words).bit_length(), 23), bucket(-(-10 * same // len(words)), 24)}
    return out


def test_scores_equal_brute_force_with_string_ids(spark):
    rows, labels = made(300, 4)
    rows += [(1000 + k, t) for k, (_, t) in enumerate(awkward()) if t is None or len(t) < 6000]
    docs = documents(spark, rows).selectExpr("concat('d', doc_id) as doc_id", "text", "1 as _id", "2 as _y", "3 as _key", "4 as score", "5 as h")
    truth = spark.createDataFrame([(f"d{i}", q, t) for i, q, t in labels], "doc_id string, quality int, toxic int")
    model = quality.fit(docs, truth)
    got = {r.id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        b = np.array(sorted(plain_buckets(text)), dtype=np.int64)
        margin = float(model.weights[b].astype(float).sum() / max(np.sqrt(model.scale[b].astype(float).sum()), 1e-9)) + model.bias if len(b) else model.bias
        assert abs(got[f"d{i}"] - 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -35, 35)))) < 1e-4
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.7}


def test_indicators_beyond_the_bound_are_left_out_of_the_fit(spark):
    rows, labels = made(200, 2)
    rows[0] = (0, " ".join(f"w{i}" for i in range(60_000)))
    docs, truth = documents(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, truth, most_features=20_000)
    scores = {r.id: r.score for r in quality.score(docs, model).collect()}
    held = [i for i in scores if i and zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(scores[i] >= 0.5) == dict((i, q) for i, q, _ in labels)[i] for i in held]) > 0.9
