"""The tag cutter against the standard library's parser, event by event."""

from __future__ import annotations

import random
from html.parser import HTMLParser

import pandas as pd
import pytest

from sievework.functions import keys
from sievework.functions.markup import VOID, page_evidence


class Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.anchors, self.open = [], [], []
        self.out = {"canonicals": [], "robots": None, "h1": 0, "ids": [], "json_ld": []}
        self.raw, self.catch = 0, False

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if "id" in a:
            self.out["ids"].append(a["id"])
        if tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.out["canonicals"].append(a.get("href", ""))
        if tag == "meta" and a.get("name", "").lower() == "robots":
            self.out["robots"] = a.get("content", "")
        self.out["h1"] += tag == "h1"
        if tag == "img":
            for x in self.open:
                x["alt"].append(a.get("alt", ""))
        if tag == "a" and "href" in a:
            self.anchors.append({"href": a["href"], "text": [], "alt": [], "label": a.get("aria-label", ""), "ancestors": " ".join(self.stack).lower(), "nested": bool(self.open)})
            self.open.append(self.anchors[-1])
        if tag in ("script", "style"):
            self.raw, self.catch = self.raw + 1, a.get("type") == "application/ld+json"
        if tag not in VOID:
            self.stack.append(" ".join([tag, a.get("class", ""), a.get("aria-label", "").lower()]).strip())

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.raw, self.catch = max(0, self.raw - 1), False
        if tag == "a" and self.open:
            self.open.pop()
        at = max((i for i, x in enumerate(self.stack) if x.split(" ")[0] == tag), default=None)
        if at is not None:
            del self.stack[at:]

    def handle_data(self, data):
        if self.catch:
            self.out["json_ld"].append(data)
        elif not self.raw:
            for x in self.open:
                x["text"].append(data)


def plain(html):
    p = Plain()
    p.feed(html)
    p.close()
    name = lambda x: x["label"] or " ".join(" ".join(x["text"]).split()) or " ".join(" ".join(x["alt"]).split())
    return p.out | {"anchors": [{k: x[k] for k in ("href", "ancestors", "nested")} | {"name": name(x)} for x in p.anchors]}


BITS = [
    '<a href="x">', "<a href=y/>", "<a href='z' class=\"q w\">", "</a>", "<div class=nav id=i1>", "</div>", "<p>", "</p>", "text & more", "a &amp; b &lt;", "1<2 3", "<!-- c <a href=q> -->", "<br/>", "<img alt='pic'>",
    "<img alt=\"o'x\"/>", '<script type="application/ld+json">{"a":"</p>"}</script>', "<style>a{}</style>", "<h1 id='t'>", "</h1>", "<link rel='canonical' href='/c'>", "<meta name=robots content='noindex'>", "<!doctype html>",
    "<?php x ?>", "</ x>", '<nav aria-label="Bread Crumb">', "</nav>", "<a>", '<A HREF="U&amp;p">', "</A>", "<a href>", "<div/>", "<b>", "</b>", "\n", "<a href='m' href='n'>", "<a title=it's href=\"k\">", "<span / class=s>", "</span>", "<a/>", "<a href='s' />", "é 漢",
]


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_standard_parser(seed):
    rng = random.Random(seed)
    for _ in range(2500):
        html = "".join(rng.choice(BITS) for _ in range(rng.randrange(14)))
        assert page_evidence(html) == plain(html), html


def test_given_pages():
    import duckdb

    for (html,) in duckdb.sql("select coalesce(html, '') from '/root/testdata/sf0.001/pages.parquet'").fetchall():
        assert page_evidence(html) == plain(html)


def test_cut_off_and_odd_pages():
    assert page_evidence("")["anchors"] == []
    assert [a["name"] for a in page_evidence("<a href='x'>one<b")["anchors"]] == ["one < b"]
    assert page_evidence("<a href='x'>t</a><!-- never closed <a href='y'>")["anchors"][0]["name"] == "t"
    assert page_evidence("<script>var a = '<a href=q>';")["anchors"] == []
    assert page_evidence('<a href="x" ' + "y" * 100_000)["anchors"] == []
    many = page_evidence('<a href="' * 20_000)
    assert many["anchors"] == []
    assert page_evidence("<" * 100_000 + "<p " * 20_000)["h1"] == 0


def test_rooted_addresses_are_resolved_once(spark, monkeypatch):
    """What begins with a slash means the same on every page, so it is worked out once for each batch."""
    calls = []
    real = keys.urljoin
    monkeypatch.setattr(keys, "urljoin", lambda *a: calls.append(a) or real(*a))
    resolve = keys.resolver("https://s.example").func
    cases = ["/", "/a/b/../c?x#f", "//other.example/x", "/a.html", "b", "", None, "mailto:x", "/%41/", "http://[", "#f"]
    routes = ["/p/q", "/", "/r?x", None, "odd"]
    href, route = zip(*[(h, r) for h in cases for r in routes], strict=True)
    got = resolve(pd.Series(href * 20, dtype=object), pd.Series(route * 20, dtype=object))
    assert sum(h[0] == "/" and not base.endswith("odd") for base, h in calls if h) == 5
    assert all(real("https://s.example" + r, h) == real("https://s.example/", h) for h in cases if h and h[0] == "/" for r in routes if r and r[0] == "/")
    each = pd.concat([resolve(pd.Series([h], dtype=object), pd.Series([r], dtype=object)) for h, r in zip(href, route, strict=True)] * 20, ignore_index=True)
    assert got.where(got.notna(), None).values.tolist() == each.where(each.notna(), None).values.tolist()
