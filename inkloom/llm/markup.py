"""HTML pages as sequences of leaf blocks with their tag paths."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset("script style template noscript svg iframe head textarea select".split())
#: Hidden elements whose content is no markup: without an end tag they reach to the page's end.
RAW = frozenset("script style textarea iframe".split())
#: So many elements of a path are kept at its beginning and at its end, if it has more.
OUTER, INNER = 16, 48
# (formulas stand within lines)
INLINE = frozenset("math mi mn mo mtext mrow msub msup msubsup mfrac msqrt mroot munder mover munderover a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSED_BY_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol table dl body html div section article main aside nav footer header form blockquote figure td th".split())

TAG_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
STOP = re.compile("[\"'>]")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]  # (element, names from class, id and role) from the root down
    linked: int  # characters within links


class Tags:
    """Tags of a page from a place on, in time that grows with the page.

    A tag ends at the first > outside quotes; if there is none, as a quote stands open, at
    the first > at all.  After `most` such faults quotes are no longer heeded.
    """

    def __init__(self, page: str, most: int = 64):
        self.page, self.faults = page, most
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.without: set[str] = set()  # elements that have no further end tag

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether an end tag, name ('' for comments and the like) and the rest of the next tag."""
        page = self.page
        while True:
            start = page.find("<", at)
            if start < 0:
                return None
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), False, "", ""
            if start > self.last[">"]:
                return None
            if page[start + 1 : start + 2] in ("!", "?"):
                return start, page.find(">", start) + 1, False, "", ""
            named = TAG_NAME.match(page, start)
            if named:
                end = self._end(named.end())
                return start, end + 1, named[1] == "/", named[2].lower(), page[named.end() : end]
            at = start + 1

    def _end(self, at: int) -> int:
        page, place = self.page, at
        while self.faults:
            stop = STOP.search(page, place)
            if stop and stop[0] == ">":
                return stop.start()
            if not stop or stop.start() >= self.last[stop[0]]:
                self.faults -= 1
                break
            place = page.find(stop[0], stop.start() + 1) + 1
        return page.find(">", at)

    def after(self, name: str, at: int) -> int | None:
        """Where the next end tag of an element ends."""
        if name in self.without:
            return None
        found = re.compile(rf"</{name}\b[^>]*>", re.I).search(self.page, at)
        if not found:
            self.without.add(name)
        return found.end() if found else None


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks in page order: runs of text that no block element interrupts.

    Elements left open are closed as a parent ends or, as in paragraphs, list items and
    cells, as the next begins.  Text of hidden elements is left out, references are
    decoded and white space is one space.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    outer: list[tuple[str, tuple[str, ...]]] = []  # those of the stack that are not inline
    count: dict[str, int] = {}  # by name
    tags = Tags(page)
    parts: list[str] = []
    path: tuple = ()
    linked = links = 0
    at = 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, path, linked))
            parts = []
        linked = 0

    def add(text):
        nonlocal path, linked
        if text:
            if not parts:
                if text.isspace():
                    return
                path = tuple(outer) if len(outer) <= OUTER + INNER else (*outer[:OUTER], *outer[-INNER:])
            parts.append(text)
            if links:
                linked += len(text)

    def close(index):
        nonlocal links
        for name, _ in stack[index:]:
            links -= name == "a"
            count[name] -= 1
            if name not in INLINE:
                outer.pop()
        del stack[index:]

    while True:
        found = tags.next(at)
        if not found:
            add(page[at:])
            break
        start, end, ending, name, rest = found
        add(page[at:start])
        at = end
        if not name:
            continue
        if ending:
            if name not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1) if count.get(name) else ():
                if stack[i][0] == name:
                    close(i)
                    break
                if name in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if name in ("svg", "math") and rest.endswith("/"):
            continue
        if name in HIDDEN:
            past = tags.after(name, at)
            if past is None and name == "head":
                body = re.compile(r"<body\b", re.I).search(page, at)
                past = body.start() if body else None
            if name != "svg":
                flush()
            at = past if past is not None else len(page) if name in RAW else at
            continue
        if name in VOID:
            if name == "br":
                add(" ")
            elif name == "hr":
                flush()
            continue
        if name not in INLINE:
            flush()
            shut = CLOSED_BY_SIBLING.get(name, ())
            for i in range(len(stack) - 1, -1, -1) if count.get("p") or any(map(count.get, shut)) else ():
                if stack[i][0] == "p" or stack[i][0] in shut:
                    close(i)
                    break
                if stack[i][0] in SCOPES and not (shut and stack[i][0] in ("td", "th")):
                    break
        names = tuple(w for m in NAMES.finditer(rest) for w in (m[1] or m[2] or m[3] or "").lower().split()) if "=" in rest else ()
        stack.append((name, names))
        count[name] = count.get(name, 0) + 1
        if name not in INLINE:
            outer.append((name, names))
        links += name == "a"
    flush()
    return out
