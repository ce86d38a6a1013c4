"""Small document tables with the awkward rows that every operator must take."""

from __future__ import annotations

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward():
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "one two three four five six"),
        (7, "one two three four five six"), (7, "one two three four five six"), (8, long), (9, long + " tail"),
        (None, "orphan text with a few words"), (10, "Größe façade naïve 漢字 emoji 🎉 ok"), (11, "x" * 5000), (12, "\n\n\n"),
    ]
