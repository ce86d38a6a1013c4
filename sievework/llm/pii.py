"""Personal data: regular expressions propose, checksums confirm, context adjusts.

DataFrame functions only.  The matches of a kind come from
``regexp_extract_all`` and what lies between them from ``split`` on the same
pattern, so a span's start is the sum of the lengths before it; sums are taken
in blocks, which keeps rows with very many matches far from quadratic work.
Patterns are written with possessive parts and look-behinds that change no
match but keep the engine from retrying inside long runs.

Kinds ``email ip card phone`` are the base: every match that passes its test
is kept, with its score.  The method adds ``iban`` (mod-97), ``ssn`` and
``secret`` (long runs of mixed letters and digits), kept from a score of
``LEAST_ADDED``.  A span's score is its kind's prior, raised where a checksum
confirms it and where a word of its kind stands close by (40 characters before
or 20 after, not beyond the kind's neighbouring match), lowered where a denying
word does: so an ``ssn`` or ``secret`` needs a word that speaks for it, and one
that speaks against an ``iban`` overrules its checksum.

Defined results: a null text is an empty one; rows are handled one by one, so
repeats, ties and null ids need no rule; other columns are left alone, whatever
their names: where the table has one called ``pii``, the added one gets
underscores after its name until it is new.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm._names import free

#: Patterns (fixed values). The first four are the base.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{20,}+={0,2}+",
}
BASE = ("email", "ip", "card", "phone")
#: Prior, what a confirming checksum adds, words that raise it, words that lower it (fixed values).
SCORES = {
    "email": (0.8, 0.0, "mail|contact|write|reply", "noreply|example"),
    "ip": (0.5, 0.0, "ip|host|server|address|from", "version|release|section"),
    "card": (0.3, 0.5, "card|visa|master|credit|debit|payment|karte|tarjeta|carte", "order|serial|isbn|tracking"),
    "phone": (0.6, 0.0, "phone|tel|call|mobile|fax|cell|whatsapp|telefon|llame", "order|serial|version"),
    "iban": (0.3, 0.35, "iban|bank|account|konto|cuenta|compte|transfer", "serial|order"),
    "ssn": (0.4, 0.0, "ssn|social|security|tax", "part|model|serial|order"),
    "secret": (0.4, 0.0, "token|secret|password|passwd|api[_-]?key|access[_-]?key|bearer|credential", "digest|checksum|sha1|sha256|md5|commit|uuid|example"),
}
LEAST_ADDED = 0.6
BLOCK = 256
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
IP_VALID = rf"^{_PART}(?:\.{_PART}){{3}}$"


def mod97(account: Column) -> Column:
    """The ISO 7064 remainder of an account number: first four characters last, letters as 10 to 35."""
    s = F.regexp_replace(account, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    value = lambda c: F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: (acc * F.when(c <= "9", 10).otherwise(100) + value(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)).cast("int"))


def _passes(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return hit.rlike(IP_VALID)
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(hit, "[^A-Z0-9]", "")).between(15, 34) & (mod97(hit) == 1)
    return F.lit(True)


def _starts(before: Column, hits: Column) -> Column:
    """Start of each hit: the lengths of all hits and pieces before it, summed by blocks."""
    steps = F.zip_with(F.slice(before, 1, F.size(hits)), hits, lambda p, h: F.struct(F.length(p).alias("gap"), F.length(h).alias("len")))
    numbers = F.sequence(F.lit(0), F.ceil(F.size(hits) / F.lit(BLOCK)).cast("int") - 1)
    zero = F.lit(0).cast("bigint")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda acc, s: acc + s["gap"] + s["len"])

    def bases(sums: Column) -> Column:
        return F.transform(sums, lambda s, i: F.aggregate(F.slice(sums, F.lit(1), i), zero, lambda acc, x: acc + x))

    def in_block(block: Column, base: Column) -> Column:
        return F.transform(block, lambda s, i: base + total(F.slice(block, F.lit(1), i)) + s["gap"])

    def from_blocks(blocks: Column) -> Column:
        return F.flatten(F.zip_with(blocks, _let(F.transform(blocks, total), bases), in_block))

    def from_steps(steps: Column) -> Column:
        return _let(F.transform(numbers, lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))), from_blocks)

    return _let(steps, from_steps)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _kept(kind: str, order: int, none: str, hits: Column, gaps: Column, starts: Column) -> Column:
    """The confirmed spans of a kind from its hits, the gaps between them and where they start."""
    prior, checked, raises, lowers = SCORES[kind]
    after = F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1)))
    rows = F.arrays_zip(hits.alias("hit"), starts.alias("at"), gaps.alias("before"), after.alias("after"))

    def span(x: Column) -> Column:
        near = F.lower(F.concat(F.right(x["before"], F.lit(40)), F.lit(" "), F.left(x["after"], F.lit(20))))
        up = F.when(near.rlike(rf"(?<![a-z])(?:{raises})"), 0.2).otherwise(0.0)
        down = F.when(near.rlike(rf"(?<![a-z])(?:{lowers})"), 0.2).otherwise(0.0)
        score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(prior + checked) + up - down)), 3)
        end = x["at"] + F.length(x["hit"])
        return F.struct(x["at"].alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("value"), score.alias("score"))

    kept = F.transform(F.filter(F.slice(rows, 1, F.size(hits)), lambda x: _passes(kind, x["hit"])), span)
    if kind not in BASE:
        kept = F.filter(kept, lambda x: x["score"] >= LEAST_ADDED)
    return F.when(F.size(hits) > 0, kept).otherwise(F.array().cast(none))


def detect(docs: DataFrame, text_col: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with an array of (start, order, end, kind, value, score) by start, then kind; code points, end exclusive."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = "array<struct<start:bigint,order:int,end:bigint,kind:string,value:string,score:double>>"
    hits, gaps, starts = ({k: free(docs, f"_{part}_{k}") for k in PATTERNS} for part in ("hits", "gaps", "from"))
    out = docs.withColumns({hits[k]: F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)) for k in PATTERNS})
    out = out.withColumns({gaps[k]: F.when(F.size(hits[k]) > 0, F.split(text, PATTERNS[k], -1)) for k in PATTERNS})
    out = out.withColumns({starts[k]: F.when(F.size(hits[k]) > 0, _starts(F.col(gaps[k]), F.col(hits[k]))) for k in PATTERNS})
    found = [_kept(kind, order, none, F.col(hits[kind]), F.col(gaps[kind]), F.col(starts[kind])) for order, kind in enumerate(PATTERNS)]
    return out.withColumn(free(docs, into), F.array_sort(reduce(lambda a, b: F.concat(a, b), found))).drop(*hits.values(), *gaps.values(), *starts.values())


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores(spans: Column) -> Column:
    """Scores of the spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every confirmed span's text replaced by its kind in brackets; spans that overlap an earlier one go with it."""
    into = free(docs, "_pii")
    found = detect(docs, text_col, into)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def step(acc: Column, s: Column) -> Column:
        piece = F.array(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), s["kind"], F.lit("]")))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["parts"], piece).alias("parts")))

    done = F.aggregate(into, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return found.withColumn(text_col, F.when(F.col(text_col).isNotNull(), done)).drop(into)
