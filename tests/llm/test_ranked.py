from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sievework.llm import ranked
from tests.llm.helpers import awkward, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(rows, items, k=10):
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in rows if terms(t)]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for i, c, length in docs:
            m = 10 + (90 * length * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, x[2], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item, r.rank, r.id, r.score) for r in df.collect()), key=str)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def corpus(seed, n=700):
    rng = random.Random(seed)
    words = [f"{'ÄÖx'[i % 3]}{i}" for i in range(300)]
    pick = lambda m: " ".join(words[min(int(rng.expovariate(0.02)), 299)] for _ in range(m))
    rows = [(i * 11 % 1009, pick(rng.choice([0, 3, 30, 30, 200]))) for i in range(n)]
    rows += [(2000 + i, rows[5][1] + " x1 x4") for i in range(60)]
    return rows, [(i, pick(rng.randint(1, 40)).upper() + "," + pick(2)) for i in range(25)]


@pytest.mark.parametrize("segment,leaf", [(400_000, 1024), (900, 4), (1, 1)])
def test_equals_brute_force(spark, monkeypatch, segment, leaf):
    """Workers see the module's own bounds, so the search itself is run here, the job with the usual ones."""
    rows, asked = corpus(1)
    want = plain(rows, asked)
    if segment == 400_000:
        assert got(ranked.search(documents(spark, rows).repartition(5), items(spark, asked))) == want
        assert got(ranked.search(documents(spark, rows).repartition(3), items(spark, asked), block_terms=100)) == want
        return
    monkeypatch.setattr(ranked, "LEAF", leaf)
    docs = sorted((i, Counter(terms(t)), len(terms(t))) for i, t in rows if terms(t))
    vocabulary = sorted({t for _, t in asked for t in terms(t)})
    n, total = len(docs), sum(x[2] for x in docs)
    weights = np.array([ranked.weight(n, df) if (df := sum(t in c for _, c, _ in docs)) else 0 for t in vocabulary])
    out = []
    for item, text in asked:
        own = np.array(sorted({vocabulary.index(t) for t in terms(text)}))
        found = []
        for at in range(0, n, max(1, segment)):
            part = docs[at : at + segment]
            posts = sorted((k, j, c[t]) for j, (_, c, _) in enumerate(part) for k, t in enumerate(vocabulary) if t in c)
            if not posts:
                continue
            term, doc, tf = (np.array(x, dtype=np.int64) for x in zip(*posts, strict=True))
            length = np.array([x[2] for x in part], dtype=np.int64)
            lists = ranked.Postings(term, doc, ranked.impacts(tf, length[doc], n, total), len(part))
            ranked.best_first(lists, own, weights[own], [x[0] for x in part], found, 10)
        out += [(item, r, x[2], -x[0]) for r, x in enumerate(found, 1)]
    assert sorted(out, key=str) == want


def test_prunes(spark, monkeypatch):
    """With one document far ahead of 4,000 others, nearly all of them are never scored."""
    monkeypatch.setattr(ranked, "LEAF", 1)
    n = 4000
    doc = np.concatenate([np.arange(n), np.arange(0, n, 7)])
    impact = np.concatenate([np.full(n, 10) + np.arange(n) % 3, np.where(np.arange(0, n, 7) == 3500, 10_000, 5)])
    lists = ranked.Postings(np.repeat([0, 1], [n, len(doc) - n]), doc, impact, n)
    asked = []
    top = lists.top
    lists.top = lambda a, b: asked.append(1) or top(a, b)
    found = ranked.best_first(lists, np.array([0, 1]), np.array([1, 1]), list(range(n)), [], 1)
    assert found == [(-10_012, False, 3500)] or found[0][2] == 3500
    assert len(asked) < 20


def test_awkward_rows_ties_and_empty_tables(spark):
    rows = awkward()
    asked = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (4, "ORPHAN the with"), (5, "größe 漢字 🎉"), (6, "absent"), (None, "six few"), (7, "w3 w4")]
    docs = documents(spark, rows).withColumnRenamed("lang", "ids").withColumnRenamed("source", "at")
    assert got(ranked.search(docs, items(spark, asked))) == plain(rows, asked)
    assert ranked.search(documents(spark, []), items(spark, asked)).count() == 0
    assert ranked.search(documents(spark, rows), items(spark, [])).count() == 0
    assert ranked.search(documents(spark, rows), items(spark, [(1, None)])).count() == 0


def test_string_ids(spark):
    rows, asked = corpus(4, 90)
    docs = documents(spark, rows).selectExpr("concat('d', doc_id) as doc_id", "text")
    assert got(ranked.search(docs, items(spark, asked))) == plain([(f"d{i}", t) for i, t in rows], asked)
