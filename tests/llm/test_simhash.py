from __future__ import annotations

import random

import numpy as np
import xxhash

from sievework.llm import simhash
from tests.llm.helpers import WORDS, awkward, documents


def plain_fingerprint(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_of_awkward_rows(spark):
    rows = awkward()
    got = simhash.fingerprints(documents(spark, rows)).collect()
    assert sorted((r.id is None, r.id or 0, r.fp & (2**64 - 1)) for r in got) == sorted((i is None, i or 0, plain_fingerprint(t)) for i, t in rows)


def test_codewords_are_seven_bits_apart_and_balls_of_three_cover():
    code = simhash.Golay()
    assert [(row >= 0).sum() for row in code.patterns].count(6) == 1771
    words = np.arange(0, 1 << 23, 997)
    found = code.indices(words)
    for bit in range(23):
        other = code.indices(words ^ (1 << bit))
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(found, other, strict=True))


def test_links_equal_brute_force(spark):
    random.seed(5)
    fps = {}
    for k in range(40):
        base = random.getrandbits(64)
        for _ in range(12):
            x = base
            for _ in range(random.randint(0, 5)):
                x ^= 1 << random.randrange(64)
            fps[len(fps)] = x
    chain = random.getrandbits(64)
    for _ in range(20):
        chain ^= 1 << random.randrange(64) | 1 << 63
        fps[len(fps)] = chain
    signed = {i: x - (1 << 64) if x >> 63 else x for i, x in fps.items()}
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed.values()], "fp bigint")).collect()
    assert all(bin((e.src ^ e.dst) & (2**64 - 1)).count("1") <= 2 for e in edges)
    from sievework.operators.graph import connected_components

    made = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    expected = plain_components(fps)
    groups, wanted = {}, {}
    for i in fps:
        groups.setdefault(made.get(signed[i], signed[i]), set()).add(i)
        wanted.setdefault(expected[i], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_and_keep_one(spark):
    rows = awkward()
    docs = documents(spark, rows).withColumn("fp", __import__("pyspark").sql.functions.lit("clash"))
    got = {r.id: r.component for r in simhash.components(docs).collect()}
    expected = plain_components({i: plain_fingerprint(t) for i, t in rows if i is not None})
    assert {i: c for i, c in got.items() if i is not None} == expected
    kept = simhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(i for i, _ in rows if i is not None and expected[i] == i)
    assert kept[0].fp == "clash" and sum(r.doc_id is None for r in kept) == 1


def test_empty_table(spark):
    assert simhash.components(documents(spark, [])).count() == 0
    assert simhash.keep_one(documents(spark, [])).count() == 0
