"""Licence scans: a trained paragraph classifier confirmed by templates.

A paragraph is a run of lines that have words, so a notice is one however it is
wrapped.  Words are runs of letters and digits, A-Z in lower case.  What is
classified are its single lines and, across line ends, its overlapping parts of
``PART`` words, so a notice is seen wherever it stands, among prose too.  A
multinomial logistic regression over sparse word pairs and triples (those of
the templates and of the ordinary sentences), with the share of words that no
known n-gram covers, names a licence family or ``unknown``.  It is fitted here
on templates that are cut, thinned, and surrounded by other words, against
shuffled templates, ordinary sentences and a bounded sample of the corpus
(``sample_lines`` lines of ``sample_docs`` documents by hash order, one part of
each, those that look like templates left out).
A temperature fitted on rows kept out of training calibrates its
probabilities; a prediction counts from ``least`` on and is confirmed if the
part holds ``contained`` of the n-grams of one of the family's templates, or
if that template holds as many of those between the first and the last n-gram
that they share, and shares ``ENOUGH`` with it.  Of predictions that overlap
in a paragraph, one goes whose matched n-grams all belong to the template of
another that matches more: it is a piece of that notice.

Parts with fewer than two n-grams of the templates (none of them has fewer)
are ``unknown`` by rule, so scoring costs next to nothing there and no part is
left out.  No shuffle.

Defined results: null, empty and blank texts have no paragraphs; rows are
independent, so repeats, ties and null ids need no rule; only the id and text
columns are read, whatever the names of the others.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm._words import rolling, slices

PART, STEP, FEWEST, ENOUGH = 60, 30, 2, 8
#: Templates of fewer n-grams than these (three words) are common in prose: they end a sentence or a line where they are a notice.
SHORT = 5
GAP = np.ones(256, dtype=bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

#: Licence families and short notices of each (fixed values).
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright, all rights reserved. No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
        "This document is confidential and proprietary; unauthorized copying or distribution is strictly prohibited.",
    ],
}
UNKNOWN = "unknown"
#: Ordinary sentences about neighbouring things (fixed values).
ORDINARY = [
    "The driver lost his license last week and had to take the bus to work.",
    "The software was released under great pressure and needed a new version soon.",
    "All the rights of citizens are reserved for later discussion in this chapter.",
    "All rights reserved by the citizens of the old town were written down for themselves.",
    "They found all rights reserved to the members listed in the charter of the club.",
    "Students at MIT released a report under the title of public health.",
    "The general public may use the foundation's garden without restriction.",
    "A copy of the book may be obtained from the library free of charge.",
    "This program is free for any person who wants to work in the commons.",
    "He was permitted to copy the source text provided that it was returned.",
    "Apache helicopters were distributed to the base in the second version of the plan.",
    "The commercial law of the state applies to every agreement in writing.",
]


def tokens(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of each text, with the scan's own words."""
    out = []
    for s in slices(pa.array(texts, pa.string()), lower=True, gap=GAP):
        words = s.word_hashes()
        out += [words[s.word_from[i] : s.word_from[i + 1]] for i in range(s.last - s.first)]
    return out


def grams(words: np.ndarray) -> np.ndarray:
    return np.concatenate([rolling(words, 2), rolling(words, 3)])


@dataclass
class Model:
    families: list[str]  # the last is unknown
    keys: np.ndarray  # sorted hashes of the n-grams known
    licence: np.ndarray  # which of them belong to a template
    weights: np.ndarray  # (n-grams + 1, families): the last row is the share of words not covered
    bias: np.ndarray
    temperature: float
    templates: list[tuple[int, np.ndarray]]  # (family, its n-grams' positions in keys)

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        z = scores / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def overlap(self, family: int, known: Grams, a: int, b: int) -> tuple[float, np.ndarray, np.ndarray]:
        """How well words a to b fit the family's best template: (share, n-grams shared, the template's n-grams).

        The share is that of the template's n-grams, or that of the n-grams between the first and the last one shared
        if ``ENOUGH`` of them are: a piece of a notice among other words.
        """
        have, _ = known.features(a, b)
        best = (0.0, have[:0], have[:0])
        for f, own in self.templates:
            if f == family and len(own):
                both = np.intersect1d(own, have, assume_unique=True)
                share = len(both) / len(own)
                if len(both) >= ENOUGH:
                    first, last = known.extent(a, b, own)
                    share = max(share, len(both) / max(len(both), 2 * (last - first) - 3))
                if (share, len(both)) > (best[0], len(best[1])):
                    best = (share, both, own)
        return best


def _known(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The position in ``keys`` of each n-gram, -1 where it is none of them."""
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return np.where(keys[at] == found, at, -1)


class Grams:
    """Which known n-grams begin at each word of a text or slice."""

    def __init__(self, keys: np.ndarray, words: np.ndarray):
        self.at = {w: _known(keys, rolling(words, w)) for w in (2, 3)}

    def counts(self, starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> np.ndarray:
        """How many of ``which`` lie in each span of words."""
        total = np.zeros(len(starts), dtype=np.int64)
        for w, at in self.at.items():
            sums = np.concatenate([[0], np.cumsum(which[at] & (at >= 0))]) if len(at) else np.zeros(1, np.int64)
            total += sums[np.clip(ends - w + 1, starts, len(at)).clip(0, len(at))] - sums[np.minimum(starts, len(at))]
        return total

    def extent(self, a: int, b: int, which: np.ndarray) -> tuple[int, int]:
        """(first word, past the last word) of the n-grams of ``which`` within words a to b."""
        first, last = b, a
        for w, at in self.at.items():
            where = np.flatnonzero(np.isin(at[a : max(a, b - w + 1)], which))
            if len(where):
                first, last = min(first, a + int(where[0])), max(last, a + int(where[-1]) + w)
        return first, last

    def features(self, a: int, b: int) -> tuple[np.ndarray, float]:
        """(distinct known n-grams, share of the words that none of them covers) of words a to b."""
        covered, seen = np.zeros(max(b - a, 0), dtype=bool), []
        for w, at in self.at.items():
            own = at[a : max(a, b - w + 1)]
            where = np.flatnonzero(own >= 0)
            seen.append(own[where])
            for k in range(w):
                covered[where + k] = True
        return np.unique(np.concatenate(seen)), 1 - covered.mean() if b > a else 1.0


def _variants(rng: random.Random, filler: list[str]) -> list[tuple[str, str]]:
    """Training paragraphs: (family, text)."""
    out = []
    surround = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = text.split()
            out += [(family, text)] * 4
            for _ in range(36):
                own = [w for w in words if rng.random() > rng.choice([0, 0, 0.05, 0.1])]
                if len(own) > 12 and rng.random() < 0.5:
                    a = rng.randrange(len(own) // 2)
                    own = own[a : a + max(9, len(own) * 2 // 3)]
                before, after = (rng.choice([0, 0, 3, 10, 25]) for _ in range(2))
                out.append((family, f"{surround(before)} {' '.join(own)} {surround(after)}"))
            for _ in range(8):  # among prose, as far as a part reaches
                before = rng.randint(0, max(0, PART - len(words)))
                out.append((family, f"{surround(before)} {text} {surround(max(0, PART - len(words) - before))}"))
            for _ in range(10):
                mixed = words[:]
                rng.shuffle(mixed)
                out.append((UNKNOWN, " ".join(mixed)))
                a = rng.randrange(max(1, len(words) - 2))
                out.append((UNKNOWN, f"{surround(rng.randint(6, 25))} {' '.join(words[a : a + 2])} {surround(rng.randint(6, 25))}"))
    out += [(UNKNOWN, s) for s in ORDINARY for _ in range(5)]
    out += [(UNKNOWN, surround(rng.randint(1, 50))) for _ in range(300)]
    return out


class Sparse:
    """Rows of distinct n-gram positions and one dense value each, multiplied without a dense matrix."""

    def __init__(self, rows: list[np.ndarray], dense: np.ndarray, width: int):
        self.flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.dense, self.n, self.width = dense[:, None].astype(np.float32), len(rows), width
        order = np.argsort(self.flat, kind="stable")
        self.by_column = self.row[order]
        self.columns, self.first = np.unique(self.flat[order], return_index=True)
        self.rows, self.begin = np.unique(self.row, return_index=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        out = self.dense * w[-1]
        if len(self.flat):
            out[self.rows] += np.add.reduceat(w[self.flat], self.begin, axis=0)
        return out

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width + 1, g.shape[1]), dtype=np.float32)
        if len(self.flat):
            out[self.columns] = np.add.reduceat(g[self.by_column], self.first, axis=0)
        out[-1] = (self.dense * g).sum(axis=0)
        return out


def train(corpus: list[str], seed: int = 11, rounds: int = 200) -> Model:
    """Fit and calibrate on variants of the templates and on ``corpus`` paragraphs taken as unknown."""
    rng = random.Random(seed)
    families = [*TEMPLATES, UNKNOWN]
    own = [(families.index(f), t) for f, texts in TEMPLATES.items() for t in texts]
    hashed = tokens([t for _, t in own])
    ours = np.unique(np.concatenate([grams(w) for w in hashed]))
    keys = np.union1d(ours, np.concatenate([grams(w) for w in tokens(ORDINARY)]))
    templates = [(f, np.unique(_known(keys, grams(w)))) for (f, _), w in zip(own, hashed, strict=True)]
    filler = sorted({w for t in corpus for w in t.split()})[:5000] or ["lorem", "ipsum", "dolor", "amet"]
    rows = _variants(rng, filler)
    words = [w[: 2 * PART] for w in tokens([t for _, t in rows])]
    labels = [families.index(f) for f, _ in rows]
    for w in tokens(corpus):
        found = Grams(keys, w).features(0, len(w))[0]
        if not any(len(np.intersect1d(t, found)) >= 0.5 * len(t) for _, t in templates):
            words.append(w)
            labels.append(len(families) - 1)
    have = [Grams(keys, w).features(0, len(w)) for w in words]
    y = np.array(labels)
    out = np.array([rng.random() < 0.25 for _ in y])
    part = lambda where: Sparse([have[i][0] for i in where], np.array([have[i][1] for i in where]), len(keys))
    fit, kept = np.flatnonzero(~out), np.flatnonzero(out)
    x, target = part(fit), np.eye(len(families), dtype=np.float32)[y[fit]]
    share = np.bincount(y[fit], minlength=len(families))
    weight = np.sqrt(len(fit) / np.maximum(share, 1))[y[fit]]
    weight = (weight / weight.sum())[:, None].astype(np.float32)
    w, b = np.zeros((len(keys) + 1, len(families)), dtype=np.float32), np.zeros(len(families), dtype=np.float32)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, rounds + 1):  # Adam on the whole training set
        z = x.times(w) + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        grad = weight * (p / p.sum(axis=1, keepdims=True) - target)
        gw, gb = x.transposed_times(grad) + 1e-5 * w, grad.sum(axis=0)
        for value, g, m, v in ((w, gw, mw, vw), (b, gb, mb, vb)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    scores, y_kept = part(kept).times(w) + b, y[kept]

    def loss(temperature: float) -> float:
        z = scores / temperature
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), y_kept]).mean())

    best = min(np.geomspace(0.25, 8, 41), key=loss)
    return Model(families, keys, np.isin(keys, ours), w, b, float(best), templates)


def _spans(new: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)


def _parts(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping parts of PART words, one every STEP, that cover each span; a shorter span is one part."""
    count = np.maximum(1, -(-(ends - starts - PART) // STEP) + 1)
    first = np.repeat(starts, count) + STEP * (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count))
    return first, np.minimum(first + PART, np.repeat(ends, count))


def _ends(s, past: int) -> bool:
    """Does more than blanks stand between the word before ``past`` and the next one of its text, or no word at all."""
    if past >= len(s.starts) or s.word_from[np.searchsorted(s.word_from, past)] == past:
        return True
    return not np.isin(s.raw[s.ends[past - 1] : s.starts[past]], (32, 9)).all()


def _settle(found: list[tuple]) -> list[tuple]:
    """Of predictions (first, past last, family, ..., shared, template) that overlap, those that aren't a piece of a larger one."""
    found = sorted(found, key=lambda x: (-len(x[6]), x[1] - x[0], x[0], x[2]))
    kept: list[tuple] = []
    for x in found:
        for y in kept:
            meet = x[0] < y[1] and y[0] < x[1]
            if meet and (x[2] == y[2] or (y[5] and np.isin(x[6], y[7], assume_unique=True).all())):
                break
        else:
            kept.append(x)
    return sorted(kept, key=lambda x: (x[0], x[1]))


def scan_column(m: Model, column: pa.Array, least: float, contained: float) -> Iterator[list[tuple[int, int, str, float, float, bool]]]:
    """For each row its predictions: (paragraph, first word, family, probability, overlap, confirmed); also its paragraph count first."""
    for s in slices(column, lower=True, gap=GAP):
        words, n = s.word_hashes(), s.last - s.first
        if not len(words):
            yield from ([0] for _ in range(n))
            continue
        line = np.searchsorted(np.flatnonzero(s.raw == 10), s.starts)
        doc = np.repeat(np.arange(n), np.diff(s.word_from))
        other = np.concatenate([[True], doc[1:] != doc[:-1]])
        step = np.diff(line, prepend=line[0])
        line_start, line_end = _spans(other | (step > 0), len(words))
        para_start, para_end = _spans(other | (step > 1), len(words))
        wrapped = np.isin(para_start, line_start) & (para_end != line_end[np.searchsorted(line_start, para_start)])
        parts = [np.concatenate(x) for x in zip(_parts(line_start, line_end), _parts(para_start[wrapped], para_end[wrapped]), strict=True)]
        known = Grams(m.keys, words)
        hit = np.flatnonzero(known.counts(*parts, m.licence) >= FEWEST)
        out: list[list] = [[] for _ in range(n)]
        if len(hit):
            spans = [(int(parts[0][i]), int(parts[1][i])) for i in hit]
            have = [known.features(a, b) for a, b in spans]
            prob = m.probabilities(np.stack([m.weights[h].sum(axis=0) + m.weights[-1] * np.float32(o) + m.bias for h, o in have]))
            by_para: dict[int, list[tuple]] = {}
            for (a, b), pr in zip(spans, prob, strict=True):
                f = int(pr.argmax())
                if f != len(m.families) - 1 and pr[f] >= least:
                    share, both, own = m.overlap(f, known, a, b)
                    p = int(np.searchsorted(para_start, a, side="right")) - 1
                    sure = share >= contained and (len(own) >= SHORT or _ends(s, known.extent(a, b, own)[1]))
                    by_para.setdefault(p, []).append((a, b, f, float(pr[f]), share, sure, both, own))
            for p, found in sorted(by_para.items()):
                d = int(doc[para_start[p]])
                before = int(np.searchsorted(para_start, s.word_from[d]))
                out[d] += [(p - before, a - int(s.word_from[d]), m.families[f], round(pr, 4), round(share, 4), sure) for a, _, f, pr, share, sure, *_ in _settle(found)]
        count = np.bincount(doc[para_start], minlength=n)
        for d in range(n):
            yield [int(count[d]), *out[d]]


def fit(docs: DataFrame, text_col: str = "text", sample_lines: int = 3000, sample_docs: int = 1000) -> Model:
    """Train with a bounded sample of the corpus as unknown paragraphs: ``sample_lines`` lines of ``sample_docs`` documents, by hash order.

    Of a line longer than ``PART`` words, a part that begins at a place drawn by its hash is taken.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(text.alias("text"), F.xxhash64(text, F.lit(3)).alias("h"))
    few = keyed.select("h").distinct().orderBy("h").limit(sample_docs)  # hashes alone are ranked, texts of the chosen read after
    some = keyed.join(F.broadcast(few), "h", "left_semi")
    words = F.split("line", r"[\x20\t]+")
    begin = F.pmod(F.xxhash64("line"), F.greatest(F.lit(1), F.size(words) - PART + 1)).cast("int") + 1
    lines = some.select(F.explode(F.split("text", "\n")).alias("line")).select(F.array_join(F.slice(words, begin, F.lit(PART)), " ").alias("line"))
    sample = lines.where("trim(line) <> ''").distinct().orderBy(F.xxhash64("line", F.lit(3)), "line").limit(sample_lines)
    return train([r.line for r in sample.collect()])


SCHEMA = "paragraphs bigint, found array<struct<paragraph:int,word:int,family:string,probability:double,overlap:double,confirmed:boolean>>"


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, contained: float = 0.6) -> DataFrame:
    """(id, paragraphs, found): per row how many paragraphs it has and each part in which a family is predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text_col))
    item = pa.struct([("paragraph", pa.int32()), ("word", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("overlap", pa.float64()), ("confirmed", pa.bool_())])
    names = [f.name for f in item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(scan_column(sent.value, batch.column(1), least, contained))
            found = [[dict(zip(names, x, strict=True)) for x in r[1:]] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array(found, pa.list_(item))], ["id", "paragraphs", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(run, f"id {kind}, {SCHEMA}")
