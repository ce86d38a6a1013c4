from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import katz
from tests.llm.helpers import WORDS, awkward, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LEARNS = "crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0"


def learns(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 != 0


class Plain:
    """The model from its definition: n-grams as tuples, weights by sums over all words seen after a context."""

    def __init__(self, texts, order):
        self.order, self.memo = order, {}
        self.grams, self.context = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
        for words in texts:
            padded = ["<s>"] * (order - 1) + words
            for j in range(order - 1, len(padded)):
                for n in range(1, order + 1):
                    gram = tuple(padded[j - n + 1 : j + 1])
                    self.grams[n][gram] += 1
                    self.context[n][gram[:-1]] += 1
        self.total, self.types = sum(self.grams[1].values()), len(self.grams[1])
        self.after = [defaultdict(set) for _ in range(order + 1)]
        for n in range(2, order + 1):
            for gram in self.grams[n]:
                self.after[n][gram[:-1]].add(gram[-1])

    def star(self, n, c):
        of = Counter(self.grams[n].values())
        r = min(c, 5)
        good = (r + 1) * of[r + 1] / of[r] if of[r] else 0
        off = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.5
        return c - r + (good if 0 < good < r else r - off)

    def p(self, gram):
        n, c = len(gram), self.grams[len(gram)][gram]
        if n == 1:
            return (c + 0.1) / (self.total + 0.1 * (self.types + 1))
        key = gram[:-1]
        t = self.context[n][key]
        if not t:
            return self.p(gram[1:])
        if c:
            return self.star(n, c) / t
        if (n, key) not in self.memo:
            seen = self.after[n][key]
            self.memo[n, key] = (1 - sum(self.star(n, self.grams[n][key + (w,)]) / t for w in seen)) / (1 - sum(self.p(key[1:] + (w,)) for w in seen))
        return self.memo[n, key] * self.p(gram[1:])


def tokens(text):
    return [*WORDS.findall((text or "").translate(LOWER)), None]


def plain(rows, order):
    m = Plain([tokens(t) for i, t in rows if learns(i)], order)
    out = []
    for i, t in rows:
        w = tokens(t)
        padded = ["<s>"] * (order - 1) + w
        score = sum(math.log10(m.p(tuple(padded[k : k + order]))) for k in range(len(w)))
        out.append((i, not learns(i), len(w), sum(m.grams[1][(x,)] > 0 for x in w), m.total, sum(math.log10(m.p((x,))) for x in w), score))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.id, not r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()), key=str)


def agree(a, b):
    assert [x[:5] for x in a] == [x[:5] for x in b]
    np.testing.assert_allclose([x[5:] for x in a], [x[5:] for x in b], rtol=1e-9)


def corpus(seed, n=300):
    rng = random.Random(seed)
    pick = lambda m: " ".join(f"{rng.choice('wW')}{min(int(rng.expovariate(0.05)), 400)}" for _ in range(m))
    rows = [(i, pick(rng.choice([0, 2, 40, 120]))) for i in range(n)]
    return rows + [(n + i, "the same passage over and over again w1") for i in range(40)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_brute_force(spark, order):
    rows = corpus(order)
    agree(got(katz.score(documents(spark, rows).repartition(4), F.expr(LEARNS), order=order)), plain(rows, order))


@pytest.mark.parametrize("order", [2, 3])
def test_each_context_sums_to_one(order):
    """The plain model, which the job equals, gives each context's words and the unknown one a sum of one."""
    m = Plain([tokens(t) for _, t in corpus(8)], order)
    words = [g[0] for g in m.grams[1]] + ["unknown"]
    for key in [*m.after[order]][:40] + [("nowhere",) * (order - 1)]:
        assert abs(sum(m.p(key + (w,)) for w in words) - 1) < 1e-9


def test_awkward_rows_and_empty_tables(spark):
    rows = awkward()
    agree(got(katz.score(documents(spark, rows).withColumnRenamed("lang", "chunk").withColumnRenamed("source", "key"), F.expr(LEARNS))), plain(rows, 2))
    assert katz.score(documents(spark, []), F.expr(LEARNS)).count() == 0
    held = [(i, "one two") for i in range(200) if not learns(i)]
    agree(got(katz.score(documents(spark, held), F.expr(LEARNS))), plain(held, 2))


def test_string_ids_and_many_chunks(spark):
    rows = [(f"d{i}", t) for i, t in corpus(6)]
    docs = documents(spark, [(i, t) for i, t in corpus(6)]).selectExpr("concat('d', doc_id) as doc_id", "text").repartition(40)
    agree(got(katz.score(docs, F.expr(LEARNS))), plain(rows, 2))


def test_packing_is_lossless():
    for x in ([], [0], [2**64 - 1, 0, 7], range(10_000)):
        x = np.array(x, dtype=np.uint64)
        assert (katz.unpack(katz.pack(x)) == x).all()


def test_good_turing_counts_fall_back():
    assert katz.discounted([0] * 6).tolist() == [0, 0.5, 1.5, 2.5, 3.5, 4.5]
    star = katz.discounted([1000, 300, 150, 90, 60, 45])
    assert star[1] == pytest.approx(0.6) and star[2] == pytest.approx(1.5) and (star[1:] < np.arange(1, 6)).all() and (star[1:] > 0).all()
