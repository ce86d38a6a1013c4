from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from sievework.llm import lines
from tests.llm.helpers import awkward, documents


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_alignment_is_a_common_subsequence_and_optimal_on_unique_lines():
    rng = random.Random(3)
    for _ in range(500):
        a = [rng.randrange(30) for _ in range(rng.randrange(25))]
        b = [rng.randrange(30) for _ in range(rng.randrange(25))]
        got = lines.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        u, v = rng.sample(range(40), 20), rng.sample(range(40), 20)
        assert len(lines.align(u, v)) == lcs(u, v)
    assert lines.align([1, 1, 2], [1, 1, 2]) == [(0, 0), (1, 1), (2, 2)] and lines.align([], [1]) == []


def shared(a, b, sizes, block):
    """Positions of ``b`` in runs of ``block`` bytes or more that stand in ``a``, by the table of common suffixes."""
    gone, row = set(), [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                if sum(sizes[j + 1 - new[j + 1] : j + 1]) >= block:
                    gone |= set(range(j + 1 - new[j + 1], j + 1))
        row = new
    return gone


def plain(rows, block=40):
    """All pairs on one machine, without hashes, keys or alignment: the runs of each document that an earlier one of other lines holds."""
    docs = {}
    for i, t in rows:
        docs[(i is None, i or 0, t or "")] = [x for x in (y.strip(" \t\r\x0b\f") for y in (t or "").split("\n")) if x]
    # documents of one id and unequal text don't occur here
    order, first, out = sorted(docs), {}, {}
    for k in order:
        if docs[k]:
            first.setdefault(tuple(docs[k]), k)
    for n, k in enumerate(order):
        gone, sizes = set(), [len(x.encode()) for x in docs[k]]
        if docs[k] and first[tuple(docs[k])] != k:
            gone = set(range(len(docs[k]))) if sum(sizes) >= block else set()
        else:
            for p in order[:n]:
                if first.get(tuple(docs[p])) == p:
                    gone |= shared(docs[p], docs[k], sizes, block)
        out[k] = [x for n, x in enumerate(docs[k]) if n not in gone]
    return out


def corpus(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("alpha beta gamma delta eta".split()) for _ in range(rng.randint(1, 9))) for _ in range(120)]
    rows = []
    for i in range(200):
        if rows and rng.random() < 0.3:
            own = rows[rng.randrange(len(rows))][1].split("\n")
            for _ in range(rng.randrange(3)):
                own.insert(rng.randint(0, len(own)), rng.choice(pool))
        else:
            own = [rng.choice(pool) if rng.random() < 0.4 else f"own line {i} {k} " + "z" * rng.randrange(40) for k in range(rng.randrange(12))]
        rows.append((i, rng.choice(["\n", "\n", "\n\n"]).join(own)))
    return rows


def kept_lines(spark, rows, **how):
    got = lines.dedup_lines(documents(spark, rows).repartition(5), **how).collect()
    assert len(got) == len(rows)
    out = {}
    for r in got:
        out[(False, r.doc_id, dict(rows)[r.doc_id])] = left = [x.strip() for x in r.text.split("\n") if x.strip()]
        assert r._lines - r._deleted == len(left)
    return out


def test_deletions_equal_all_pairs(spark):
    rows = corpus(1)
    want = plain(rows)
    lines_of = {k: [x for x in k[2].split("\n") if x.strip()] for k in want}
    gone = {k: len(lines_of[k]) - len(want[k]) for k in want}
    assert sum(gone.values()) > 100 and sum(not n for n in gone.values()) > 50
    assert kept_lines(spark, rows) == want


def test_blocks_in_another_order_and_of_equal_lines_go(spark):
    a, b = ("\n".join(f"block {x} line {k} of some bytes" for k in range(4)) for x in "AB")
    rows = [(0, f"zero\n{b}\nmiddle\n{a}\nend")] + [(k, f"head {k}\n{a}\nown {k}\n{b}\ntail {k}") for k in range(1, 14)]
    rows += [(20, "start\n" + "\n".join(["x" * 35] * 10) + "\nend 20"), (21, "other start\n" + "\n".join(["x" * 35] * 10) + "\nend 21")]
    got = kept_lines(spark, rows)
    assert got == plain(rows)
    assert all(got[False, k, dict(rows)[k]] == [f"head {k}", f"own {k}", f"tail {k}"] for k in range(1, 14))
    assert got[False, 21, dict(rows)[21]] == ["other start", "end 21"]


def test_common_blocks_equal_shared_runs():
    rng = random.Random(12)
    for _ in range(600):
        size = {x: rng.choice([3, 15, 25, 39, 40]) for x in range(9)}
        a, b = ([rng.randrange(9) for _ in range(rng.randrange(14))] for _ in range(2))
        sizes = [size[x] for x in b]
        assert set(lines.common_blocks(a, b, sizes, 40)) == shared(a, b, sizes, 40)


def test_awkward_rows_and_empty_table(spark):
    rows = [*awkward(), (30, "a line that is long enough to be told apart\nshort"), (31, "a line that is long enough to be told apart\nother"), (None, "a line that is long enough to be told apart")]
    docs = documents(spark, rows).withColumnRenamed("lang", "lines")
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_lines", "_deleted"]
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = [(i, t) for i, t in rows if (i, t[:6] if t else t) not in ((31, "a line"), (None, "a line"))] + [(31, "other"), (None, "")]
    # 8 and 9 are one long line each and differ
    assert got == sorted(want, key=str)
    assert lines.dedup_lines(documents(spark, [])).count() == 0
    assert out.where(F.col("text").isNull()).count() == 1


def all_pairs(rows, block=40):
    """Positions that go if every document is aligned with every earlier one, for documents of different ids and lines."""
    docs = [[x for x in t.split("\n") if x.strip()] for _, t in sorted(rows)]
    out = []
    for k, own in enumerate(docs):
        gone = set()
        for before in docs[:k]:
            gone |= set(lines.common_blocks(before, own, [len(x.encode()) for x in own], block))
        out.append([x for n, x in enumerate(own) if n not in gone])
    return out


def test_blocks_of_short_lines_and_of_lines_with_other_earlier_holders(spark):
    verse = [f"short {k} {k * k}" for k in range(12)]
    run = [f"a line of some bytes no {k:3d}" for k in range(6)]  # 27 bytes each
    rows = [(k, f"head of document {k}\n{x}\ntail of document {k}") for k, x in enumerate(run)]
    rows += [(10, "\n".join(["first", *verse, "end"])), (11, "\n".join(["second", *verse[2:9], "other end"]))]
    rows += [(12, "\n".join(["b", *run, "b tail"])), (13, "\n".join(["c", *run, "c tail"]))]
    # 15 shares a long line with 9 and the short line after it with 14 alone
    rows += [(14, "own\n" + "long " * 9 + "\nshort"), (15, "mine\n" + "long " * 9 + "\nshort"), (9, "theirs\n" + "long " * 9)]
    rng = random.Random(4)
    for k in range(20, 120):
        own = [f"own {k} {n}" for n in range(6)]
        source, cut = rng.choice([verse, run]), rng.randrange(7)
        at = rng.randrange(len(source))
        rows.append((k, "\n".join([*own[:cut], *source[at : at + rng.randint(1, 6)], *own[cut:]])))
    want = all_pairs(rows)
    got = lines.dedup_lines(documents(spark, rows).repartition(5)).orderBy("doc_id").collect()
    kept = {r.doc_id: [x for x in r.text.split("\n") if x.strip()] for r in got}
    assert kept[11] == ["second", "other end"] and kept[13] == ["c", "c tail"] and kept[15] == ["mine"]
    assert sum(map(len, kept.values())) == sum(map(len, want)) and list(kept.values()) == want


def test_minimal_runs_cover_every_heavy_block():
    rng = random.Random(9)
    for _ in range(300):
        sizes = np.array([rng.choice([3, 10, 25, 39, 40, 60]) for _ in range(rng.randint(1, 12))])
        runs = lines.minimal_runs(sizes, 40)
        for i in range(len(sizes)):
            for j in range(i + 1, len(sizes) + 1):
                inside = {k for a, b in runs if i <= a and b <= j for k in range(a, b)}
                assert inside == (set(range(i, j)) if sizes[i:j].sum() >= 40 else set())


def test_string_ids_and_clashing_names(spark):
    rows = [(30, "a line that is long enough to be told apart\nshort"), (31, "a line that is long enough to be told apart\nother")]
    docs = documents(spark, rows).selectExpr("concat('d', doc_id) as doc_id", "text", "1 as _id", "2 as _content", "3 as _gone", "4 as _lines", "5 as _deleted", "6 as _doc", "7 as rep")
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_lines_", "_deleted_"]
    got = {r.doc_id: r for r in out.collect()}
    assert got["d30"].text == rows[0][1] and got["d31"].text == "other" and got["d31"]._deleted_ == 1
    assert all((r._id, r._content, r._gone, r._lines, r._deleted, r._doc, r.rep) == (1, 2, 3, 4, 5, 6, 7) for r in got.values())


def test_copies_of_hot_owners_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(lines, "PAIRS", 3)
    block = "\n".join(f"line {k} of a passage that all share" for k in range(3))
    rows = [(k, f"own {k}\n{block}\nend {k}") for k in range(40)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(documents(spark, rows).repartition(4)).collect()}
    assert got[0] == rows[0][1] and all(got[k] == f"own {k}\nend {k}" for k in range(1, 40))
