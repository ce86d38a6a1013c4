"""Column functions that normalise titles, tokens, slugs and prose.

All but the two Unicode foldings are built-in expressions.  Word lists,
spellings and rules are arguments, never constants of the library.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as the source's regular expressions mean it: with no-break and Unicode spaces (fixed values).
BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
APOSTROPHES = r"['’‘`´]"
DASHES = r"[-‐‑‒–—―]"
#: Signs of a search key, one by one: Java tests a list by one look, ranges beside a sign six times slower.
KEPT = "abcdefghijklmnopqrstuvwxyz0123456789+"


@lru_cache(maxsize=1)
def _marks() -> re.Pattern:
    return re.compile("[" + "".join(chr(c) for c in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(c))) + "]+")


def _folded(text: pa.Array, fold: Callable[[str], str]) -> pa.Array:
    """A few rows at a time as strings; the batch itself stays in Arrow."""
    parts = [pa.array([s if s is None else fold(s) for s in text.slice(at, 100).to_pylist()], pa.string()) for at in range(0, len(text), 100)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _without_marks(text: pa.Array) -> pa.Array:
    return _folded(text, lambda s: _marks().sub("", unicodedata.normalize("NFD", s)))


@F.arrow_udf(StringType())
def _composed(text: pa.Array) -> pa.Array:
    return _folded(text, lambda s: unicodedata.normalize("NFKC", s))


def _beyond_ascii(c: Column, fold: Callable[[Column], Column]) -> Column:
    """ASCII texts stay as they are and aren't sent to Python."""
    some = F.octet_length(c) > F.length(c)
    return F.when(some, fold(F.when(some, c))).otherwise(c)


def strip_marks(c: Column) -> Column:
    """Canonical decomposition without combining marks; no built-in function has it."""
    return _beyond_ascii(c, _without_marks)


def compatible(c: Column) -> Column:
    """Compatibility composition (NFKC)."""
    return _beyond_ascii(c, _composed)


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def search_key(c: Column) -> Column:
    """Letters without marks, digits and plus signs, in lower case, one space between words."""
    plain = F.regexp_replace(F.lower(strip_marks(c)), APOSTROPHES, "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, DASHES, " "), f"[^{KEPT}]+", " "))


def title_key(c: Column) -> Column:
    """Exact-title key; apostrophes and dashes unified."""
    c = F.lower(squeeze(compatible(c)))
    return F.regexp_replace(F.regexp_replace(c, APOSTROPHES, "'"), DASHES, "-")


def loose_title_key(c: Column) -> Column:
    """N2 without punctuation."""
    return F.trim(F.regexp_replace(title_key(c), r"[^\p{L}\p{N}]+", " "))


def slug(c: Column) -> Column:
    """Lower-case words joined by hyphens, ampersands spelled out."""
    words = F.regexp_replace(F.lower(F.regexp_replace(c, "&", " and ")), r"[^a-z0-9]+", "-")
    return F.regexp_replace(words, "^-+|-+$", "")


def match_text(c: Column, spellings: Mapping[str, str] = {}) -> Column:
    """Lower case, spellings corrected word by word, quotes dropped, all else a space."""
    c = F.lower(c)
    for wrong, right in spellings.items():
        c = F.regexp_replace(c, rf"\b{wrong}\b", right)
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"['\"’“”]", ""), r"[^a-z0-9]+", " "))


def words(c: Column) -> Column:
    """The words of a normalised text."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def match_words(c: Column) -> Column:
    """``words(match_text(c))``, cut where the text stands: one pass over its words instead of three."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(c), r"['\"’“”]", ""), "[^a-z0-9]+"), "")


def singular_plain(w: Column) -> Column:
    """Ies to y, es after a hissing sound, s but not ss."""
    n = F.length(w)
    return (
        F.when((n > 4) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & w.rlike("(ch|sh|x|z|ss)es$"), F.substring(w, F.lit(1), n - 2))
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), n - 1))
        .otherwise(w)
    )


def singular_short(w: Column) -> Column:
    """One final s, but not ss, us or is, of words longer than three."""
    return F.when((F.length(w) > 3) & w.endswith("s") & ~w.rlike("(ss|us|is)$"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def singular_known(w: Column, vocabulary: Sequence[str]) -> Column:
    """The singular only if the vocabulary has it."""
    one = singular_plain(w)
    return F.when(one.isin(*vocabulary), one).otherwise(w) if vocabulary else w


def token(w: Column, stop: Sequence[str] = (), replace: Mapping[str, str] = {}, vocabulary: Sequence[str] = ()) -> Column:
    """Null for stop words and single letters; replacement, then singular if known."""
    r = w
    for a, b in replace.items():
        r = F.when(w == a, b).otherwise(r)
    out = singular_known(r, vocabulary)
    return F.when((F.length(w) > 1) & (~w.isin(*stop) if stop else F.lit(True)), out)


def token_profile(title: Column, broad: Sequence[str], stop: Sequence[str]) -> Column:
    """Distinct tokens in order, split into strong and broad ones."""
    tokens = F.array_distinct(F.transform(F.filter(words(match_text(title)), lambda w: (F.length(w) > 2) & ~w.isin(*stop) & ~w.rlike("^[0-9]+$")), singular_plain))
    return F.struct(tokens.alias("tokens"), F.filter(tokens, lambda w: ~w.isin(*broad)).alias("strong"), F.filter(tokens, lambda w: w.isin(*broad)).alias("broad"))


def significant_tokens(c: Column, phrases: Sequence[str] = (), least: int = 4, stop: Sequence[str] = ()) -> Column:
    """Distinct longer tokens of a text without shared phrases."""
    c = F.lower(c)
    for p in phrases:
        c = F.replace(c, F.lit(p), F.lit(" "))
    found = F.filter(words(match_text(c)), lambda w: F.length(w) >= least)
    if stop:
        found = F.filter(found, lambda w: ~w.isin(*stop))
    return F.array_distinct(F.transform(found, singular_short))


def presentation_group(title: Column, stop: Sequence[str] = ()) -> Column:
    """The first two content tokens, or ``other``."""
    content = F.filter(words(match_text(title)), lambda w: (F.length(w) > 2) & (~w.isin(*stop) if stop else F.lit(True)))
    group = F.array_join(F.slice(F.transform(content, singular_short), 1, 2), " ")
    return F.when(group == "", "other").otherwise(F.coalesce(group, F.lit("other")))


def near_title_key(title: Column) -> Column:
    """The first four words longer than two letters."""
    return F.array_join(F.slice(F.filter(words(match_text(title)), lambda w: F.length(w) > 2), 1, 4), " ")


def sorted_slug(c: Column) -> Column:
    """A slug's parts in order, so that reordered slugs meet."""
    return F.array_join(F.array_sort(F.filter(F.split(slug(c), "-"), lambda w: w != "")), "-")


def file_terms(name: Column, drop: Sequence[str] = ()) -> Column:
    """A file name's words without export words, months' names given in ``drop``, and numbers."""
    c = F.regexp_replace(F.regexp_replace(F.lower(name), r"\.[a-z0-9]{2,4}$", ""), r"[^a-z0-9]+", " ")
    if drop:
        c = F.regexp_replace(c, rf"\b({'|'.join(drop)})\b", " ")
    return squeeze(F.regexp_replace(c, r"\b[0-9]+\b", " "))


def unrepeat(c: Column) -> Column:
    """Words without those that repeat the word before them (which is, or equals, the last one kept)."""
    kept = F.transform(F.array(words(squeeze(c))), lambda w: F.filter(w, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(w, i - 1)))))[0]
    return F.array_join(kept, " ")


def clean_stem(name: Column, fallback: Column, drop: Sequence[str] = (), spellings: Mapping[str, str] = {}, most: int = 72) -> Column:
    """A file stem: dropped words and doubled words gone, spellings mended, cut at a word's end; else the fallback."""
    c = match_text(F.regexp_replace(name, r"\.[A-Za-z0-9]{2,4}$", ""), spellings)
    if drop:
        c = squeeze(F.regexp_replace(c, rf"\b({'|'.join(drop)})\b", " "))
    c = F.regexp_replace(unrepeat(c), " ", "-")
    cut = F.when(F.length(c) <= most, c).otherwise(F.coalesce(F.nullif(F.regexp_extract(F.substring(c, 1, most + 1), "^(.*)-[^-]*$", 1), F.lit("")), F.substring(c, 1, most)))
    return F.coalesce(F.nullif(cut, F.lit("")), F.nullif(slug(fallback), F.lit("")), F.lit("item"))


def corrected_title(title: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Rules applied in turn and doubled words dropped; with a flag for each thing that changed it."""
    steps, flags = squeeze(title), []
    for pattern, new in rules:
        after = F.regexp_replace(steps, pattern, new)
        flags.append(F.when(~after.eqNullSafe(steps), F.lit(f"rule:{pattern}")))
        steps = after
    done = unrepeat(steps)
    flags.append(F.when(~done.eqNullSafe(squeeze(steps)), F.lit("doubled-word")))
    return F.struct(done.alias("title"), F.array_compact(F.array(*flags)).alias("flags"))


def bounded_title(title: Column, suffix: str, most: int = 128) -> Column:
    """A title with a suffix, cut at a word's end to fit."""
    room = most - len(suffix)
    cut = F.regexp_extract(F.substring(title, 1, room + 1), r"^(.*) ", 1)
    head = F.when(F.length(title) <= room, title).otherwise(F.when(cut != "", F.rtrim(cut)).otherwise(F.substring(title, 1, room)))
    return F.concat(head, F.lit(suffix))


def readable(html: Column) -> Column:
    """Text of a fragment: tags out, common entities read, white space squeezed."""
    c = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return squeeze(c)


def collection_label(title: Column, tail: str = "Pages") -> Column:
    """A collection's title without its trailing noun."""
    return F.regexp_replace(title, rf"(?i)\s+{tail}$", "")
