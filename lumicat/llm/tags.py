"""Reads the tags of a page from front to back. Each character is looked at a fixed number of times, also in broken pages: what
can't be closed any more is known after one failed search, and an unclosed script or comment goes to the end of the page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

# fixed values: elements whose content is no markup, by the HTML standard
RAW = frozenset("script style textarea title xmp noembed iframe noframes".split())
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"[^<>\"']*")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


class Tag(NamedTuple):
    """``start`` and ``end`` in the page; ``name`` in lower case, empty for comments and declarations. ``rest``: the attributes."""

    start: int
    end: int
    name: str
    closing: bool
    rest: str


def _end(html: str, at: int) -> int:
    """Behind the ``>`` of a tag whose name ends at ``at``; -1 if there is none. Quotes may hold ``>``, unless they are broken."""
    k = at
    while True:
        k = _PLAIN.match(html, k).end()
        if k >= len(html) or html[k] == "<":
            break
        if html[k] == ">":
            return k + 1
        closed = html.find(html[k], k + 1)
        if closed < 0:
            break
        k = closed + 1
    return html.find(">", at) + 1 or -1


def tags(html: str) -> Iterator[Tag]:
    at = 0
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
            yield Tag(at, end, "", False, "")
            at = end
            continue
        named = _NAME.match(html, at)
        if named is None and html[at + 1: at + 2] not in ("!", "?", "/"):
            at += 1
            continue
        end = _end(html, named.end() if named else at + 1)
        if end < 0:
            return  # nothing behind it ends either
        if named is None:
            yield Tag(at, end, "", False, "")
        else:
            name, closing = named[1].lower(), html[at + 1] == "/"
            rest = html[named.end(): end - 1]
            if not closing and name in RAW:
                closed = _RAW_END[name].search(html, end)
                end = closed.end() if closed else len(html)
            yield Tag(at, end, name, closing, rest)
        at = end


def without_tags(html: str) -> str:
    """The text between tags, with a space for each."""
    out, at = [], 0
    for tag in tags(html):
        out.append(html[at: tag.start])
        at = tag.end
    return " ".join([*out, html[at:]])
