"""Column functions for identities, hashes, addresses and small numeric rules."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions.text import slug


def stable_id(path: Column, n: int = 10) -> Column:
    """The first ``n`` hex digits of a path's SHA-256."""
    return F.substring(F.sha2(path, 256), 1, n)


def asset_id(category: Column, name: Column, path: Column) -> Column:
    """Category, name and path hash, two underscores between."""
    return F.concat_ws("__", slug(category), slug(name), stable_id(path))


def object_key(kind: Column, category: Column, stem: Column, ident: Column, extension: Column) -> Column:
    return F.concat(F.concat_ws("/", kind, slug(category), F.concat_ws("-", stem, ident)), F.lit("."), extension)


def page_route(root: Column, page: Column) -> Column:
    """A listing's route: page one has no suffix."""
    return F.when(page <= 1, root).otherwise(F.concat(root, F.lit("/page/"), page.cast("string")))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the characters of an ASCII string, unsigned."""
    step = lambda h, ch: (h.bitwiseXOR(F.ascii(ch).cast("bigint")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    chars = F.filter(F.split(c, ""), lambda ch: ch != "")
    return F.aggregate(chars, F.lit(2166136261).cast("bigint"), step)


def digest_of(lines: Column) -> Column:
    """SHA-256 of lines in order (an aggregate over a small table)."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), "\n"), 256)


HREF = "kind string, target string, has_query boolean, has_hash boolean, had_trailing_slash boolean, fragment string"


def resolver(site: str, ignored: Sequence[str] = ("mailto", "tel", "javascript", "data")):
    """An Arrow function that resolves hrefs against their page's route on ``site``."""
    host = urlsplit(site).netloc

    def one(href: str | None, route: str | None) -> tuple:
        href = (href or "").strip()
        try:
            parts = urlsplit(href)
            if parts.scheme in ignored:
                return parts.scheme, None, False, False, False, None
            full = urlsplit(urljoin(site + (route or "/"), href))
        except ValueError:
            return "malformed", None, False, False, False, None
        if full.scheme not in ("http", "https"):
            return "other", None, False, False, False, None
        path = unquote(full.path) or "/"
        slash = len(path) > 1 and path.endswith("/")
        path = path.rstrip("/") or "/"
        if full.netloc != host:
            kind = "noncanonical" if full.netloc.removeprefix("www.") == host.removeprefix("www.") else "external"
            return kind, f"{full.scheme}://{full.netloc}{path}", bool(full.query), bool(full.fragment), slash, full.fragment or None
        last = path.rsplit("/", 1)[-1]
        kind = "file" if "." in last else "internal"
        return kind, path, bool(full.query), bool(full.fragment), slash, full.fragment or None

    @F.pandas_udf(HREF)
    def resolve(href: pd.Series, route: pd.Series) -> pd.DataFrame:
        rows, known = [], {}
        for h, r in zip(href, route, strict=True):
            # what begins with a slash is the same on every page
            if not (h and h[0] == "/" and (not r or r[0] == "/")):
                rows.append(one(h, r))
                continue
            if h not in known:
                known[h] = one(h, "/")
            rows.append(known[h])
        return pd.DataFrame(rows, columns=[x.split(" ")[0] for x in HREF.split(", ")])

    return resolve


def path_problem(path: Column) -> Column:
    """Why a relative path is unsafe, or null."""
    return (
        F.when(path.isNull() | (F.trim(path) == ""), "empty")
        .when(path.startswith("/") | path.rlike("^[A-Za-z]:"), "absolute")
        .when(path.contains("\\"), "backslash")
        .when(path.rlike(r"(^|/)\.\.(/|$)"), "parent")
        .when(path.rlike("//"), "empty-part")
        .when(path.rlike(r"[^A-Za-z0-9/._-]"), "character")
    )


def orientation(width: Column, height: Column) -> Column:
    """N23."""
    return F.when((width <= 0) | (height <= 0), None).when(width == height, "square").when(width > height, "landscape").when(width < height, "portrait")


def three_day_key(ts: Column) -> Column:
    """Year and three-day window within it; windows restart each first of January."""
    return F.concat_ws("-", F.year(ts), F.lpad(F.floor((F.dayofyear(ts) - 1) / 3).cast("string"), 3, "0"))


def page_number(raw: Column, pages: Column) -> Column:
    """A page parameter as a number between one and the last page."""
    n = F.when(raw.rlike("^[0-9]{1,9}$"), raw.cast("int"))
    return F.greatest(F.lit(1), F.least(F.coalesce(n, F.lit(1)), pages))


def nearest_rank(values: str, p: float) -> Column:
    """The value at rank ceil(p x n), not interpolated."""
    return F.expr(f"percentile_disc({p}) within group (order by {values})")
