from __future__ import annotations

import random
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest

from sievework.llm import licenses
from tests.llm.helpers import awkward, documents


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    vocab = [f"{a}{b}" for a in "ab cd ef gh ij kl mn".split() for b in "on er th re at".split()]
    return licenses.train([" ".join(rng.choice(vocab) for _ in range(rng.randint(2, 40))) for _ in range(800)])


def families(model, text):
    row = next(iter(licenses.scan_column(model, pa.array([text]), 0.5, 0.6)))
    return {x[2] for x in row[1:] if x[5]}


def test_held_out_variants_are_recognised(model):
    rng = random.Random(77)
    good = total = 0
    for family, text in licenses._variants(rng, ["zug", "baum", "haus", "wald"]):
        if family != licenses.UNKNOWN:
            good += family in families(model, text)
            total += 1
    assert good / total > 0.9
    wrong = sum(bool(families(model, t)) for f, t in licenses._variants(random.Random(5), ["zug", "baum"]) if f == licenses.UNKNOWN)
    assert wrong / 1000 < 0.02


@pytest.mark.parametrize("family", list(licenses.TEMPLATES))
def test_every_template_is_found(model, family):
    for text in licenses.TEMPLATES[family]:
        assert families(model, f"some words first\n{text}\nand others") == {family}, text
        assert families(model, text.upper()) == {family}


def test_unknown_and_long_paragraphs(model):
    assert all(not families(model, s) for s in [*licenses.ORDINARY, "", "licence", "the MIT of the License under", "Ouan the of rend and"])
    long = " ".join(f"w{i}" for i in range(500))
    assert families(model, f"{long} Licensed under the Apache License, Version 2.0. {long}") == {"Apache-2.0"}


def test_scan_counts_paragraphs_and_slices_agree(spark, model):
    rows = [*awkward(), (50, "one\ntwo words\n\nReleased under the MIT License."), (51, "All rights reserved.\nLicensed under CC BY-NC 4.0.")]
    got = licenses.scan(documents(spark, rows).withColumnRenamed("lang", "found"), model).collect()
    by = {r.id: r for r in got}
    assert len(got) == len(rows)
    assert by[50].paragraphs == 2 and [(x.paragraph, x.family, x.confirmed) for x in by[50].found] == [(1, "MIT", True)]
    assert [(x.paragraph, x.word, x.family) for x in by[51].found] == [(0, 0, "proprietary"), (0, 3, "CC-BY-NC")]
    assert by[1].paragraphs == by[2].paragraphs == by[3].paragraphs == by[12].paragraphs == 0 and not by[8].found
    texts = [t for _, t in rows]
    alone = [next(iter(licenses.scan_column(model, pa.array([t], pa.string()), 0.5, 0.6))) for t in texts]
    assert alone == list(licenses.scan_column(model, pa.array(texts, pa.string()), 0.5, 0.6))


def test_fit_on_empty_table(spark):
    docs = documents(spark, [])
    assert licenses.scan(docs).count() == 0


#: Notices as they stand in files, not taken from the templates.
NOTICES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}


@pytest.mark.parametrize("columns", [24, 40, 72, 10_000])
@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_notices(model, columns, mark):
    for family, text in NOTICES.items():
        body = "\n".join(mark + x for x in textwrap.wrap(text, columns))
        assert families(model, f"import os\n\n{body}\n\nvalue = 1") == {family}, (family, columns)


def plain_scan(model, text, least=0.5, contained=0.6):
    """The same definition, part by part, without slices or running sums."""
    count, found = 0, []
    own = {len(licenses.TEMPLATES)}
    paragraphs, word, ends = [], 0, []
    for line in (text or "").split("\n"):
        line = re.sub("[A-Z]", lambda m: m[0].lower(), line)
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", line)
        # is anything but blanks behind each word; a line's last word is one
        ends += [not re.fullmatch(r"[ \t]+", x) for x in re.findall(r"[0-9a-z\x80-\U0010ffff]+([^0-9a-z\x80-\U0010ffff]*)", line)[:-1]] + [True] * bool(words)
        if not words:
            paragraphs.append([])
        else:
            (paragraphs or paragraphs.append([]) or paragraphs)[-1].append(words)
    for lines in filter(None, paragraphs):
        units, at = [], 0
        whole = [w for x in lines for w in x]
        for x in [*lines, *([whole] if len(lines) > 1 else [])]:
            first = 0 if x is whole and len(lines) > 1 else at
            k = 0
            while True:
                units.append((first + k, x[k : k + licenses.PART]))
                if k + licenses.PART >= len(x):
                    break
                k += licenses.STEP
            at += len(x)
        hits = []
        for first, part in units:
            hashes = licenses.tokens([" ".join(part)])[0]
            grams = [g for g in licenses.grams(hashes).tolist()]
            known = [int(i) for i in licenses._known(model.keys, np.array(grams, dtype=np.uint64))] if grams else []
            if sum(k >= 0 and bool(model.licence[k]) for k in known) < licenses.FEWEST:
                continue
            have = np.unique([k for k in known if k >= 0])
            covered = set()
            for w in (2, 3):
                for i in range(len(part) - w + 1):
                    if licenses._known(model.keys, licenses.rolling(hashes[i : i + w], w))[0] >= 0:
                        covered |= set(range(i, i + w))
            score = model.weights[have].sum(axis=0) + model.weights[-1] * np.float32(1 - len(covered) / len(part)) + model.bias
            pr = model.probabilities(score[None])[0]
            f = int(pr.argmax())
            if f not in own and pr[f] >= least:
                share, both, template = model.overlap(f, licenses.Grams(model.keys, hashes), 0, len(part))
                sure = share >= contained
                if sure and len(template) < 5:
                    sure = ends[word + first + licenses.Grams(model.keys, hashes).extent(0, len(part), template)[1] - 1]
                hits.append((first, first + len(part), f, pr[f], share, sure, both, template))
        found += [(count, word + x[0], model.families[x[2]], x[5]) for x in licenses._settle(hits)]
        count, word = count + 1, word + len(whole)
    return [count, *found]


def test_scan_equals_brute_force(model):
    rng = random.Random(12)
    notices = [x for ts in licenses.TEMPLATES.values() for x in ts] + list(NOTICES.values()) + licenses.ORDINARY
    texts = [t for _, t in awkward() if t is None or len(t) < 10_000]
    for _ in range(60):
        bits = []
        for _ in range(rng.randint(0, 6)):
            own = rng.choice(notices) if rng.random() < 0.6 else " ".join(rng.choice(["of", "the", "copy", "zug", "haus"]) for _ in range(rng.randint(1, 150)))
            bits.append("\n".join(textwrap.wrap(own, rng.choice([20, 60, 5000]))))
        texts.append(rng.choice(["\n", "\n\n", " "]).join(bits))
    got = list(licenses.scan_column(model, pa.array(texts, pa.string()), 0.5, 0.6))
    for t, g in zip(texts, got, strict=True):
        assert [g[0], *((p, w, f, sure) for p, w, f, _, _, sure in g[1:])] == plain_scan(model, t), t


def test_prose_that_holds_a_short_notice_is_not_confirmed(model):
    prose = ["All rights reserved by the citizens of the old town for themselves", "He kept all rights reserved for later years", "all rights reserved to them were sold"]
    for text in prose:
        assert not any(x[5] for x in next(iter(licenses.scan_column(model, pa.array([text], pa.string()), 0.5, 0.6)))[1:]), text
    for text in ["All rights reserved.", "Copyright 2020 Some House. All rights reserved", "(c) A. B. All rights reserved. Printed in town.", "all rights reserved\nby the house"]:
        assert families(model, text) == {"proprietary"}, text
