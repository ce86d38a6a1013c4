from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from sievework.llm import benchmark, lines, mixing, quality, simhash
from tests.llm import test_benchmark, test_jaccard, test_lines, test_mixing, test_quality
from tests.llm.helpers import WORDS, awkward, documents
from tests.llm.test_simhash import plain_components, plain_fingerprint


def tables(spark, root, rows, labels, items):
    documents(spark, rows).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def corpus():
    rng = random.Random(8)
    vocab = [f"word{i}" for i in range(900)]
    item = " ".join(rng.choice(vocab) for _ in range(24))
    rows, labels = [], []
    for i in range(240):
        good = rng.random() < 0.8
        text = "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(12, 25))) for _ in range(rng.randint(2, 6)))
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif rows and rng.random() < 0.15:
            text = rng.choice(rows)[1]
        elif rng.random() < 0.1:
            text += "\n" + item
        rows.append((i, text, f"s{rng.randrange(4)}"))
        labels.append((i, int(good), 0))
    rows += [(1000 + (i or 0), t, "awk") for i, t in awkward()]
    return rows, labels, [(1, item)]


def test_stages_take_effect_one_by_one(spark, tmp_path):
    rows, labels, items = corpus()
    sf = tables(spark, tmp_path, rows, labels, items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        assert k == 4 or docs.columns == columns
        if k == 0:
            scores = quality.score(spark.createDataFrame(before, spark.read.parquet(f"{sf}/documents.parquet").schema), quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))).collect()
            want = sorted(s.id for s in scores if s.score >= 0.7)
        elif k == 1:
            done = lines.dedup_lines(spark.createDataFrame(before, after and docs.schema)).collect()
            want = sorted(r.doc_id for r in done if r._deleted < r._lines or not r._deleted)
        elif k == 2:
            groups = plain_components({r.doc_id: plain_fingerprint(r.text) for r in before})
            want = sorted(r.doc_id for r in before if groups[r.doc_id] == r.doc_id)
        elif k == 3:
            words = benchmark.lower_words(items[0][1])
            want = sorted(r.doc_id for r in before if b" ".join(words) not in b" ".join(benchmark.lower_words(r.text or "")))
        else:
            copies = {r.id: r.copies for r in mixing.decide(spark.createDataFrame(before, docs.select(columns).schema)).collect()}
            want = sorted(i for i, c in copies.items() if c)
            assert all(r.copies == copies[r.doc_id] and r.taken == r.copies * len(WORDS.findall(r.text or "")) for r in after)
        assert sorted(r.doc_id for r in after) == want, name
        assert len(after) < len(before) or k >= 3, name


def near_corpus():
    """Documents of one line each, so that line dedup leaves near copies (1 to 5 of 150 words changed) to the near stage; some hold an item with a changed word."""
    rng = random.Random(21)
    vocab = [f"word{i}" for i in range(4000)]
    item = [rng.choice(vocab) for _ in range(25)]
    rows, labels = [], []
    for i in range(160):
        words = [rng.choice(vocab) for _ in range(150)]
        if rows and rng.random() < 0.4:
            words = rng.choice(rows)[1].split(" ")
            for at in rng.sample(range(len(words)), rng.randint(1, 5)):
                words[at] = f"new{i}x{at}"
        elif rng.random() < 0.15:
            found = list(item)
            found[rng.randrange(25)] = "changed"
            words[40:65] = found
        good = rng.random() < 0.8
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), f"s{rng.randrange(3)}"))
        labels.append((i, int(good), 0))
    rows += [(1000 + (i or 0), t, "awk") for i, t in awkward() if t is None or len(t) < 6000]
    rows += [(2000, "a line that is long enough to be told apart\n" + rows[0][1] + "\nown end", "s1"), (2001, "a line that is long enough to be told apart", None), (2002, None, None)]
    return rows, labels, [(1, " ".join(item)), (2, None)]


def plain_score(model, text):
    b = np.array(sorted(test_quality.plain_buckets(text)), dtype=np.int64)
    margin = model.bias
    if len(b):
        margin += float(model.weights[b].astype(float).sum() / max(np.sqrt(model.scale[b].astype(float).sum()), 1e-9))
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.offset, -35, 35)))


def test_stages_equal_plain_versions(spark, tmp_path):
    """Each stage's rows from its own input, by definitions that share no code with the stages but the fitted weights."""
    rows, labels, items = near_corpus()
    sf = tables(spark, tmp_path, rows, labels, items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/plain{k}")
        docs = spark.read.parquet(f"{tmp_path}/plain{k}")
        after = {r.doc_id: r for r in docs.collect()}
        if k == 0:
            want = {i for i, t, _ in before if plain_score(model, t) >= 0.7}
        elif k == 1:
            kept = {key[1]: x for key, x in test_lines.plain([r[:2] for r in before]).items()}
            solid = {i: [x for x in (t or "").split("\n") if x.strip()] for i, t, _ in before}
            want = {i for i, x in kept.items() if x or not solid[i]}
            assert all([x.strip() for x in (after[i].text or "").split("\n") if x.strip()] == kept[i] for i in want)
            assert all(after[i].n_chars == len(after[i].text or "") for i in want if len(kept[i]) < len(solid[i]))
        elif k == 2:
            groups = test_jaccard.plain_components([r[:2] for r in before])
            want = {i for i, c in groups.items() if i == c}
            assert sum(i != c for i, c in groups.items()) > 20
        elif k == 3:
            patterns = [benchmark.lower_words(t) for _, t in items if t]
            want = {i for i, t, _ in before if not any(test_benchmark.plain(p, benchmark.lower_words(t or "")) <= len(p) // 5 for p in patterns)}
            assert len(want) < len(before)
        else:
            want = {i for i in after}
            got = mixing.decide(spark.createDataFrame(before, "doc_id bigint, text string, source string")).collect()
            test_mixing.check(before, got, 0.05)
            assert {r.id: r.copies for r in got if r.copies} == {i: r.copies for i, r in after.items()}
        assert set(after) == want, name


def test_run_gives_the_last_stages_rows(spark, tmp_path):
    rows, labels, items = corpus()
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, rows[:60], labels, items))
    assert out.count() > 0 and {"doc_id", "text", "copies", "taken"} <= set(out.columns)
    assert simhash.components(out).where("id <> component").count() == 0


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [], [])).count() == 0
