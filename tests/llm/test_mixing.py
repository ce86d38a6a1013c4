from __future__ import annotations

import random

from sievework.llm import mixing
from tests.llm.helpers import WORDS, awkward, documents


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if weight[s] * level > most * sizes[s] + 1e-9]
        if not over:
            return fixed | {s: weight[s] * level for s in rest}
        fixed |= {s: most * sizes[s] for s in over}


def check(rows, got, tolerance):
    """Copies are whole, so a source can miss its target by what its largest document weighs."""
    sizes, words, largest = {}, {}, {}
    for r in rows:
        n = len(WORDS.findall(r[1] or ""))
        s = r[2] if len(r) > 2 else "s"
        sizes[s] = sizes.get(s, 0) + n
        largest[s] = max(largest.get(s, 0), n)
    want = plain_targets(sizes)
    assert sum(r.n for r in got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.copies <= 2 or not r.size
        words[r.source] = words.get(r.source, 0) + r.size * r.copies * r.n
    for s, n in sizes.items():
        assert abs(words[s] - want[s]) <= tolerance * n + largest[s], (s, words[s], want[s])


def corpus(n, seed):
    rng = random.Random(seed)
    names = [*(f"src{i}" for i in range(7)), None, ""]
    return [(i, "w " * int(rng.paretovariate(1.1) * 8) if rng.random() > 0.02 else None, rng.choice(names) if rng.random() < 0.6 else "src3") for i in range(n)]


def test_targets_equal_resharing_until_none_is_above(spark):
    rng = random.Random(2)
    for k in range(6):
        sizes = {rng.choice("abcdefghij") + str(i): rng.choice([0, 1, 7, 100, 5000]) for i in range(rng.randint(1, 9))} | ({None: 50} if k % 2 else {})
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
        want = plain_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in sizes)


def test_words_taken_come_near_targets_and_reruns_agree(spark):
    rows = corpus(9000, 1)
    got = mixing.decide(documents(spark, rows)).collect()
    check(rows, got, 0.01)
    again = mixing.decide(documents(spark, rows).repartition(7)).collect()
    assert {(r.id, r.copies) for r in got} == {(r.id, r.copies) for r in again}


def test_fractions_are_kept_in_sum_and_expectation(spark, monkeypatch):
    rows = [(i, "a b c", f"s{i % 2}") for i in range(400)]
    taken = {}
    for seed in range(8):
        monkeypatch.setattr(mixing, "SEED", seed)
        got = mixing.decide(documents(spark, rows)).collect()
        for s in ("s0", "s1"):
            own = [r for r in got if r.source == s]
            assert abs(sum(r.copies for r in own) - own[0].target / 3) <= 1
        for r in got:
            taken.setdefault(r.source, []).append(r.copies)
    assert len({tuple(x[:200]) for x in taken.values()}) == 2


def test_awkward_rows_clashing_columns_and_empty_table(spark):
    rows = [*awkward(), (20, None, None), (None, "x y", None), (None, "x y", None)]
    docs = documents(spark, rows).withColumnRenamed("n_chars", "target")
    check(rows, mixing.decide(docs).collect(), 0.01)
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "size", "source_size", "mix_target", "copies", "taken"] and out.where("copies < 1").count() == 0
    assert mixing.decide(documents(spark, [])).count() == 0 and mixing.mix(documents(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = mixing.decide(documents(spark, corpus(50, 3)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_names_of_the_joins_own_columns_stay(spark):
    docs = documents(spark, [(1, "a b c", "x"), (2, "d", "y")]).selectExpr("concat('d', doc_id) as doc_id", "text", "source", "1 as _id", "2 as _source", "3 as _content", "4 as _i", "5 as _s", "6 as _t", "7 as mix_size", "8 as SIZE")
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "mix_size_", "source_size", "target", "copies", "taken"]
    rows = out.collect()
    assert rows and all((r._id, r._source, r._content, r._i, r._s, r._t, r.mix_size, r.SIZE) == (1, 2, 3, 4, 5, 6, 7, 8) for r in rows)
