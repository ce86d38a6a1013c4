from __future__ import annotations

import random

import pytest

from sievework.llm import benchmark
from tests.llm.helpers import awkward, documents


def plain(item, text):
    """Smallest edit distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_equals_plain_distance():
    rng = random.Random(1)
    for _ in range(400):
        item = [rng.randrange(4) for _ in range(rng.choice([1, 3, 9, 70]))]
        text = [rng.randrange(4) for _ in range(rng.randrange(90))]
        bits = {}
        for at, w in enumerate(item):
            bits[w] = bits.get(w, 0) | 1 << at
        got = benchmark.myers(bits, len(item), text, len(item))
        assert (got[0] if got else len(item)) == min(plain(item, text), len(item))


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 45)))) for i in range(25)]
    items += [(100, None), (101, ""), (None, "null id item with seven words here"), (102, " ".join(["la"] * 80))]
    rows = []
    for d in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.7:
            own = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randint(0, max(1, len(own) // 3))):
                if own:
                    k = rng.randrange(len(own))
                    own[k : k + rng.randint(0, 1)] = [rng.choice(vocab)] * rng.randint(0, 2)
            at = rng.randint(0, len(words))
            words[at:at] = own
        rows.append((1000 + d, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    return rows, items


@pytest.mark.parametrize("block", [1_000_000, 200])
def test_matches_equal_brute_force(spark, block):
    rows, items = corpus(2)
    rows += [r for r in awkward() if r[0] not in (8, 9)]
    docs, bench = documents(spark, rows).withColumnRenamed("lang", "item_id"), spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(((r.id, r.item_id, r.distance) for r in benchmark.matches(docs, bench, block_words=block).collect()), key=str)
    want = []
    for d, text in rows:
        words = benchmark.lower_words(text or "")
        for i, item in items:
            pattern = benchmark.lower_words(item or "")
            if pattern and (x := plain(pattern, words)) <= len(pattern) // 5:
                want.append((d, i, x))
    assert len(want) > 50 and got == sorted(want, key=str)
    dirty = {d for d, _, _ in want}
    clean = benchmark.keep_clean(docs, bench, block_words=block)
    assert clean.columns == docs.columns
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((d for d, _ in rows if d not in dirty), key=str)


def test_places_and_empty_tables(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = documents(spark, [(1, "x y " + item.replace("gamma", "GAMMA").replace("eta theta", "theta") + " z")])
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    r = benchmark.matches(docs, bench).collect()[0]
    assert (r.item_id, r.distance, r.start_word, r.end_word) == (7, 1, 2, 11)
    assert benchmark.matches(docs, bench.limit(0)).count() == 0 and benchmark.keep_clean(docs, bench.limit(0)).count() == 1
    assert benchmark.matches(documents(spark, []), bench).count() == 0


def test_short_items_string_ids_and_clashing_names(spark):
    rows = [(1, "he wrote four words exactly here again"), (2, "four words exactly there"), (3, "Yes"), (4, "no")]
    docs = documents(spark, rows).selectExpr("concat('d', doc_id) as doc_id", "text", "1 as item_id", "2 as id", "3 as distance")
    bench = spark.createDataFrame([("a", "four words exactly here"), ("b", "yes"), ("c", "   "), (None, "NO")], "item_id string, text string")
    for block in (1_000_000, 2):
        got = sorted((tuple(r) for r in benchmark.matches(docs, bench, block_words=block).collect()), key=str)
        assert got == [("d1", "a", 0, 4, 2, 6), ("d3", "b", 0, 1, 0, 1), ("d4", None, 0, 1, 0, 1)]
        clean = benchmark.keep_clean(docs, bench, block_words=block)
        assert clean.columns == docs.columns and [tuple(r) for r in clean.collect()] == [("d2", rows[1][1], 1, 2, 3)]
