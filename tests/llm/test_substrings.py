from __future__ import annotations

import random

import pytest

from sievework.llm import substrings
from tests.llm.helpers import WORDS, awkward, documents


def plain(rows, window):
    seen, out = {}, []
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in order:
        w = WORDS.findall(t or "")
        for k in range(len(w) - window + 1):
            seen.setdefault(tuple(w[k : k + window]), (i, k))
    for i, t in rows:
        w = WORDS.findall(t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] != (i, k):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    passages = [" ".join(f"p{rng.randrange(40)}" for _ in range(rng.randint(18, 60))) for _ in range(8)]
    rows = []
    for i in range(400):
        parts = [" ".join(f"u{rng.randrange(6)}" for _ in range(rng.randint(0, 40))) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randrange(4), rng.choice(passages))
        if rng.random() < 0.1:
            parts.append("la " * rng.randint(15, 70))
        rows.append((i * 7 % 401, rng.choice([" ", "\n", "\t "]).join(parts)))
    return rows


@pytest.mark.parametrize("cells", [1 << 30, 1 << 13])
def test_equals_brute_force(spark, cells):
    rows = corpus(3)
    assert got(substrings.remove_repeats(documents(spark, rows).repartition(5), max_cells=cells)) == plain(rows, 20)


def test_hot_passage_over_many_batches(spark):
    rng = random.Random(1)
    passage = " ".join(f"h{i}" for i in range(30))
    rows = [(i, f"{rng.random()} " * 25 + passage + f" {rng.random()}" * 25) for i in range(1200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert got(substrings.remove_repeats(documents(spark, rows).repartition(9))) == plain(rows, 20)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_awkward_rows_and_empty_table(spark):
    rows = awkward()
    assert got(substrings.remove_repeats(documents(spark, rows).withColumnRenamed("lang", "marks"))) == plain(rows, 20)
    assert substrings.remove_repeats(documents(spark, [])).count() == 0


def test_string_ids_and_clashing_names(spark):
    rows = corpus(5)[:60]
    docs = documents(spark, rows).selectExpr("concat('d', lpad(doc_id, 4, '0')) as doc_id", "text", "1 as id", "2 as number", "3 as position", "4 as doc", "5 as marks")
    want = [(f"d{i:04d}", *rest) for i, *rest in plain(rows, 20)]
    assert got(substrings.remove_repeats(docs)) == sorted(want, key=str)
