from __future__ import annotations

import itertools
import random
import re

from sievework.llm import interactions
from tests.llm.helpers import WORDS, awkward, documents


def plain(rows, labels):
    """rows: (id, text, part); labels: (id, quality, toxic)."""
    masks = []
    for i, t, part in rows:
        t = t or ""
        w = WORDS.findall(t)
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        fails += "E" * (i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows))
        good, toxic = (any(x[0] == i and i is not None and x[k] == 1 for x in labels) for k in (1, 2))
        masks.append((part or "", fails, good, toxic))
    out = []
    for part in {m[0] for m in masks}:
        own = [m[1:] for m in masks if m[0] == part]
        some = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                failing = sum(f in m[0] for m in own)
                some.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(m[0] == f for m in own), sum(m[1] for m in gone), sum(m[2] for m in gone)))
        out += [(*r, sum(x[4] for x in some if x[1][x[2] - 1] == r[1][r[2] - 1])) for r in some]
    return sorted(out)


def got(df):
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        words = [rng.choice(["the", "Ab", f"w{rng.randrange(900)}", f"w{rng.randrange(9)}"]) for _ in range(rng.choice([0, 5, 150, 250, 400]))]
        text = " ".join(words + ["#"] * (rng.random() < 0.2))
        if rng.random() < 0.2 and rows:
            text = rng.choice(rows)[1]
        rows.append((i * 7 % 307, text.lower() if text and rng.random() < 0.5 else text, rng.choice(["en", "de", None, ""])))
    labels = [(rng.randrange(320), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(200)]
    return rows, labels


def run(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 as part", "2 as mask", "3 as cells", "4 as digest", "5 as good")
    return interactions.audit(docs.repartition(5), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_equals_brute_force(spark):
    rows, labels = corpus(2)
    before = spark.conf.get(interactions.ROWS)
    assert got(run(spark, rows, labels)) == plain(rows, labels)
    assert spark.conf.get(interactions.ROWS) == before


def test_awkward_rows_and_empty_tables(spark):
    rows = [(i, t, p) for (i, t), p in zip(awkward(), itertools.cycle(["a", None, ""]))] + [(None, "one", "a"), (40, "one", "a"), (40, "one", "b"), (4, "one", "b")]
    assert got(run(spark, rows, [(4, 1, 0), (None, 1, 1)])) == plain(rows, [(4, 1, 0), (None, 1, 1)])
    assert got(run(spark, rows, [])) == plain(rows, [])
    assert run(spark, [], []).count() == 0


def test_more_parts_than_the_usual_row_limit(spark):
    spark.conf.set(interactions.ROWS, "1000")
    try:
        assert run(spark, [(i, "x", f"p{i}") for i in range(12)], []).count() == 12 * 600
    finally:
        spark.conf.unset(interactions.ROWS)


def test_string_ids(spark):
    docs = documents(spark, [(2, "a"), (10, "a"), (1, "b")]).selectExpr("concat('d', doc_id) as doc_id", "text", "lang")
    labels = spark.createDataFrame([("d2", 1, 0)], "doc_id string, quality int, toxic int")
    rows = [("d2", "a", "en"), ("d10", "a", "en"), ("d1", "b", "en")]
    assert got(interactions.audit(docs, labels)) == plain(rows, [("d2", 1, 0)])
