"""Leaf blocks of HTML pages: runs of inline content with the elements around them.

A tolerant reader: comments and the contents of scripts, styles and the like are skipped, end tags that fit
nothing are ignored, end tags that are missing are implied where the next tag demands it. Each block
has its text (character references decoded, white space as one space), how much of it is
link text, and a number for the chain of elements around it. Chains are interned in a
``Paths`` table, so what is derived from a chain is derived once.
"""

from __future__ import annotations

import re
from html import unescape

# Fixed values of HTML: element categories and the end tags that a start tag implies.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text of the page.
SILENT = set("audio button canvas datalist head noscript object select svg template video".split())
_METADATA = set("base link meta noscript script style template title".split())
#: Holds a training page's label and is no feature.
LABEL = "x-label"
#: A start tag ends an open element of these, if one is open below the given bounds.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)), "option": (("option",), ("select", "datalist")),
}
#: An end tag reaches no further up than these.
_WALLS = set("table td th".split())
_OVER_WALLS = _WALLS | set("tr tbody thead tfoot body html".split())

#: Bounded, so that odd quotes don't make every tag search the whole page; longer ones end at the next bracket.
_ATTRIBUTES = r"""((?:[^<>"']++|"[^"]{0,2000}+"|'[^']{0,2000}+'){0,200}+)"""
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    rf"|<(script|style|iframe|noframes|title|textarea|xmp)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^<>]*+>|\Z)"
    rf"|<(/?)([a-z][^\s/<>]*+){_ATTRIBUTES}>"
    r"|<(/?)([a-z][^\s/<>]*+)([^<>]*+)>"
    r"|<[!?/][^<>]*+>", re.S | re.I)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")


class Paths:
    """Chains of elements as numbers; 0 is the empty chain."""

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.parent, self.tag, self.own, self.seen, self.main = [0], [""], [()], [frozenset()], [None]
        self.names: dict[str, tuple[tuple[str, ...], bool | None]] = {}

    def child(self, parent: int, tag: str, attributes: str) -> int:
        at = self.number.get((parent, tag, attributes))
        if at is None:
            names, main = self._named(attributes) if attributes else ((), None)
            own = {f"in {tag}", *(f"name {n}" for n in names)} if tag != LABEL else set()
            seen = self.seen[parent]
            new = tuple(sorted(own - seen))
            at = self.number[parent, tag, attributes] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
            self.own.append(new)
            self.seen.append(seen | own if new else seen)
            self.main.append(self.main[parent] if main is None else main)
        return at

    def _named(self, attributes: str) -> tuple[tuple[str, ...], bool | None]:
        """Words of class, id and role; a label, where training pages carry one."""
        got = self.names.get(attributes)
        if got is None:
            names, main = set(), None
            for key, *values in _NAMED.findall(attributes):
                value = "".join(values)
                if key.lower() == "data-main":
                    main = value == "1"
                else:
                    names.update(p.lower() for p in _PARTS.findall(value))
            got = self.names[attributes] = tuple(sorted(names)), main
        return got


def blocks(html: str, paths: Paths) -> list[tuple[int, str, int]]:
    """(path, text, characters of it in links) of each leaf block in page order."""
    out: list[tuple[int, str, int]] = []
    stack: list[tuple[str, int]] = []  # (tag, path)
    count: dict[str, int] = {}  # open elements by tag, so that the stack is only searched for what is there
    parts: list[str] = []
    path = at = silent = links = linked = last = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((at, text, linked))
            parts, linked = [], 0

    def pop(depth: int) -> None:
        """Closes the elements above ``depth``."""
        nonlocal path, silent, links
        while len(stack) > depth:
            tag = stack.pop()[0]
            count[tag] -= 1
            silent -= tag in SILENT
            links -= tag == "a"
            if tag in BLOCK:
                flush()
        path = stack[-1][1] if stack else 0

    def innermost(tags: tuple[str, ...] | set[str], walls: tuple[str, ...] | set[str]) -> int:
        """Depth of the innermost open element of ``tags`` within ``walls``, -1 if there is none."""
        if not any(count.get(t) for t in tags):
            return -1
        for d in range(len(stack) - 1, -1, -1):
            if stack[d][0] in tags:
                return d
            if stack[d][0] in walls:
                break
        return -1

    def text(s: str) -> None:
        nonlocal at, linked
        if silent:
            return
        if s.isspace():
            if parts:
                parts.append(" ")
            return
        if "&" in s:
            s = unescape(s)
        if not parts:
            at = path
        if links:
            linked += len(s.strip())
        parts.append(s)

    for m in _TOKEN.finditer(html):
        if m.start() > last:
            text(html[last:m.start()])
        last = m.end()
        tag = m.group(4) or m.group(7)
        if not tag:
            if m.group(1) and m.group(1).lower() == "title":
                flush()
            continue
        tag = tag.lower()
        if m.group(3) or m.group(6):  # an end tag
            if tag == "br":
                text(" ")
            elif (d := innermost((tag,), () if tag in _OVER_WALLS else _WALLS)) >= 0:
                pop(d)
            elif tag in BLOCK:
                flush()
            continue
        if stack and silent and stack[-1][0] == "head" and tag not in _METADATA:
            pop(len(stack) - 1)
        if tag == "br":
            text(" ")
        if tag in BLOCK:
            flush()
            if (d := innermost(("p",), _WALLS | {"button", "object"})) >= 0:
                pop(d)
            if tag in _IMPLIED and (d := innermost(*_IMPLIED[tag])) >= 0:
                pop(d)
        if tag in VOID:
            continue
        path = paths.child(path, tag, m.group(5) or m.group(8) or "")
        stack.append((tag, path))
        count[tag] = count.get(tag, 0) + 1
        silent += tag in SILENT
        links += tag == "a"
    if last < len(html):
        text(html[last:])
    flush()
    return out
