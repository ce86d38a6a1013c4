"""LG1: one page's anchors and head evidence from its tags, cut by one pattern that runs outside of Python."""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

#: Elements without an end tag (fixed values).
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
#: Elements whose content is no markup (fixed values).
RAW = frozenset({"script", "style"})

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]*+|["'][^>]*+)"""
_ATTRIBUTE = rf"[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+"
#: A tag (mark of an end, name, attributes), a comment, or another construct that shows nothing.
TAG = re.compile(rf"<(?:(/?+)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)>|!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/>|/[^a-zA-Z>][^>]*+(?:>|\Z))", re.DOTALL)
_ATTRIBUTES = re.compile(rf"([^\s/>][^\s/>=]*+)(?:\s*+(=)\s*+({_VALUE}))?+")
_HIDDEN = re.compile("<[!?]")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


@lru_cache(maxsize=4096)
def attributes(raw: str) -> dict[str, str]:
    """Names in lower case and values without quotes and character references; of equal names the last."""
    out = {}
    for name, given, value in _ATTRIBUTES.findall(raw):
        if given and value[:1] in ("'", '"') and len(value) > 1 and value[-1] == value[0]:
            value = value[1:-1]
        out[name.lower()] = unescape(value) if "&" in value else value
    return out


@lru_cache(maxsize=4096)
def _step(name: str, raw: str) -> str:
    """What a stack of ancestors says of an element."""
    a = attributes(raw)
    return " ".join([name, a.get("class", ""), a.get("aria-label", "").lower()]).strip()


def _closes_itself(raw: str) -> bool:
    """Does a tag end in a slash that belongs to no value."""
    if not raw.endswith("/"):
        return False
    last = None
    for last in _ATTRIBUTES.finditer(raw):
        pass
    return last is None or last.end() < len(raw)


def page_evidence(html: str) -> dict:
    """canonicals, robots, h1, ids, json_ld and anchors (href, label, ancestors, nested, and pieces of text and alt) of a page."""
    out: dict = {"canonicals": [], "robots": None, "h1": 0, "ids": [], "json_ld": [], "anchors": []}
    stack: list[tuple[str, str]] = []
    open_: list[dict] = []
    at, done, m = 0, False, None
    past = html.rfind(">") + 1  # no tag ends behind it, so none is looked for
    while not done:
        done = True
        for m in TAG.finditer(html, at, past):
            start = m.start()
            if open_ and start > at:
                piece = html[at:start]
                for x in open_:
                    x["text"].append(piece)
            at = m.end()
            ends, name, raw = m.group(1, 2, 3)
            if name is None:
                continue
            name = name.lower()
            if not ends:
                if raw:
                    a = attributes(raw)
                    if "id" in a:
                        out["ids"].append(a["id"])
                    if name == "a":
                        if "href" in a:
                            x = {"href": a["href"], "text": [], "alt": [], "label": a.get("aria-label", ""), "ancestors": " ".join(_step(n, r) for n, r in stack).lower(), "nested": bool(open_)}
                            out["anchors"].append(x)
                            open_.append(x)
                    elif name == "link":
                        if "canonical" in a.get("rel", "").lower().split():
                            out["canonicals"].append(a.get("href", ""))
                    elif name == "meta":
                        if a.get("name", "").lower() == "robots":
                            out["robots"] = a.get("content", "")
                    if name == "img":
                        for x in open_:
                            x["alt"].append(a.get("alt", ""))
                if name == "h1":
                    out["h1"] += 1
                itself = raw and _closes_itself(raw)
                if name in RAW and not itself:
                    stack.append((name, raw))
                    end = _ENDS[name].search(html, at)
                    if end is None:
                        end_at, done = len(html), True
                    else:
                        end_at, done = end.start(), False
                    if end_at > at and raw and attributes(raw).get("type") == "application/ld+json":
                        out["json_ld"].append(html[at:end_at])
                    at = end_at
                    if done:
                        return _named(out)
                    break
                if itself:
                    if name == "a" and open_:
                        open_.pop()
                elif name not in VOID:
                    stack.append((name, raw))
                continue
            if name == "a" and open_:
                open_.pop()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
    if open_ and at < len(html) and not (m and m.end() == at and html[at - 1] != ">"):
        # what an open comment or declaration holds is no text
        piece = _HIDDEN.split(html[at:], maxsplit=1)[0]
        for x in open_:
            x["text"].append(piece)
    return _named(out)


def _clean(pieces: list[str]) -> str:
    # a sign that begins no tag stands for itself
    return " ".join(unescape(" ".join(pieces).replace("<", " < ")).split())


def _named(out: dict) -> dict:
    for x in out["anchors"]:
        text, alt = x.pop("text"), x.pop("alt")
        x["name"] = x.pop("label") or _clean(text) or " ".join(" ".join(alt).split())
    return out
