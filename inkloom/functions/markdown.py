"""Markdown as XHTML: CommonMark's blocks and spans as documents of this engine use them, with tables and strikethrough.

Block structure is read line by line into a tree of (kind, ...) tuples; spans are read by
one pass over a text that keeps code, links, raw markup and delimiter runs as tokens and
then pairs the runs.  Reference definitions, setext headings under several lines and
HTML blocks that begin within a paragraph are not read.
"""

from __future__ import annotations

import re
from html import escape

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$")
HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
ITEM = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])(?:( +|\t)(.*))?$")
QUOTE = re.compile(r"^ {0,3}> ?")
DELIMITER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
HTML = re.compile(r"^ {0,3}<(?:/?[A-Za-z][A-Za-z0-9-]*[\s/>]|!--|\?)")
SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")

SPAN = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~])|(?P<code>(?P<ticks>`+)(?!`)(?P<inner>.+?)(?<!`)(?P=ticks)(?!`))|(?P<auto><[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*>)"
    r"|(?P<raw></?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|<!--.*?-->)"
    r"|(?P<entity>&(?:[A-Za-z][A-Za-z0-9]{1,31}|\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6});)|(?P<break>(?: {2,}|\\)\n)|(?P<image>!\[)|(?P<open>\[)|(?P<close>\])|(?P<run>\*+|_+|~~)|(?P<text>[^\\`<&!\[\]*_~ \n]+|.|\n)",
    re.S,
)
TARGET = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:\s+(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'))?\s*\)")


def to_xhtml(text: str | None) -> str:
    """The body of a page; a null text is an empty one."""
    lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")
    return "".join(_block(b) for b in _blocks(lines))


def _blocks(lines: list[str]) -> list[tuple]:
    out: list[tuple] = []
    para: list[str] = []

    def close():
        if para:
            out.append(("p", "\n".join(x.lstrip() for x in para).rstrip()))
            para.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        fence = FENCE.match(line)
        if not line.strip():
            close()
        elif fence:
            close()
            mark, body, indent = fence[1], [], len(line) - len(line.lstrip())
            i += 1
            while i < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$", lines[i]):
                body.append(re.sub(rf"^ {{0,{indent}}}", "", lines[i]))
                i += 1
            out.append(("code", fence[2].split()[0] if fence[2].split() else "", "".join(x + "\n" for x in body)))
        elif not para and line.startswith("    "):
            body = []
            while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip()):
                body.append(lines[i][4:])
                i += 1
            while body and not body[-1].strip():
                body.pop()
            out.append(("code", "", "".join(x + "\n" for x in body)))
            continue
        elif HEADING.match(line):
            close()
            found = HEADING.match(line)
            out.append(("h", len(found[1]), (found[2] or "").strip()))
        elif len(para) == 1 and SETEXT.match(line):
            out.append(("h", 1 if line.strip()[0] == "=" else 2, para.pop().strip()))
        elif RULE.match(line):
            close()
            out.append(("hr",))
        elif QUOTE.match(line):
            close()
            inner = []
            while i < len(lines) and lines[i].strip() and (QUOTE.match(lines[i]) or not _begins(lines[i])):
                inner.append(QUOTE.sub("", lines[i], count=1))
                i += 1
            out.append(("quote", _blocks(inner)))
            continue
        elif ITEM.match(line) and (not para or (ITEM.match(line)[4] or "").strip() and ITEM.match(line)[2] in ("-", "*", "+", "1.", "1)")):
            close()
            i = _list(lines, i, out)
            continue
        elif not para and HTML.match(line):
            body = []
            while i < len(lines) and lines[i].strip():
                body.append(lines[i])
                i += 1
            out.append(("html", "\n".join(body) + "\n"))
            continue
        elif not para and "|" in line and i + 1 < len(lines) and DELIMITER.match(lines[i + 1]) and "-" in lines[i + 1] and len(_cells(line)) == len(_cells(lines[i + 1])):
            ways = [{(True, True): "center", (True, False): "left", (False, True): "right"}.get((c.startswith(":"), c.endswith(":"))) for c in _cells(lines[i + 1])]
            rows, i = [_cells(line)], i + 2
            while i < len(lines) and lines[i].strip() and not _begins(lines[i]):
                rows.append((_cells(lines[i]) + [""] * len(ways))[: len(ways)])
                i += 1
            out.append(("table", ways, rows))
            continue
        else:
            para.append(line)
        i += 1
    close()
    return out


def _begins(line: str) -> bool:
    """Whether a line begins a block of its own."""
    return bool(FENCE.match(line) or HEADING.match(line) or RULE.match(line) or QUOTE.match(line) or ITEM.match(line))


def _cells(line: str) -> list[str]:
    bare = re.sub(r"(?<!\\)\|$", "", line.strip().removeprefix("|"))
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", bare)]


def _list(lines: list[str], i: int, out: list[tuple]) -> int:
    """Reads a list from line i on; the line after it."""
    first = ITEM.match(lines[i])
    sign, start = first[2][-1], first[2][:-1]
    items, loose, blank = [], False, False
    while i < len(lines):
        found = ITEM.match(lines[i])
        if not found or found[2][-1] != sign or RULE.match(lines[i]):
            break
        gap = len(found[3] or " ")
        width = len(found[1]) + len(found[2]) + (gap if gap <= 4 and found[4] else 1)
        loose |= blank and bool(items)
        body, blank = [lines[i][width:]], False
        i += 1
        while i < len(lines):
            line = lines[i]
            if not line.strip():
                blank = True
                body.append("")
            elif line.startswith(" " * width):
                loose |= blank and not _nested(body)
                blank = False
                body.append(line[width:])
            elif blank or _begins(line):
                break
            else:
                body.append(line.lstrip())
            i += 1
        while body and not body[-1]:
            body.pop()
        items.append(_blocks(body))
    out.append(("list", None if sign in "-*+" else int(start), loose, items))
    return i


def _nested(body: list[str]) -> bool:
    """Whether the last line with text stands in a list or block below the item."""
    last = next((x for x in reversed(body) if x), "")
    return last.startswith(" ") or bool(ITEM.match(last)) and last is not body[0]


def _block(b: tuple, tight: bool = False) -> str:
    kind = b[0]
    if kind == "p":
        return spans(b[1]) + "\n" if tight else f"<p>{spans(b[1])}</p>\n"
    if kind == "h":
        return f"<h{b[1]}>{spans(b[2])}</h{b[1]}>\n"
    if kind == "hr":
        return "<hr />\n"
    if kind == "code":
        name = f' class="language-{escape(b[1])}"' if b[1] else ""
        return f"<pre><code{name}>{escape(b[2])}</code></pre>\n"
    if kind == "html":
        return b[1]
    if kind == "quote":
        return "<blockquote>\n" + "".join(map(_block, b[1])) + "</blockquote>\n"
    if kind == "table":
        style = lambda way: f' style="text-align:{way}"' if way else ""
        row = lambda tag, cells: "<tr>\n" + "".join(f"<{tag}{style(w)}>{spans(c)}</{tag}>\n" for w, c in zip(b[1], cells)) + "</tr>\n"
        body = "<tbody>\n" + "".join(row("td", r) for r in b[2][1:]) + "</tbody>\n" if b[2][1:] else ""
        return f"<table>\n<thead>\n{row('th', b[2][0])}</thead>\n{body}</table>\n"
    tag = "ul" if b[1] is None else "ol"
    start = f' start="{b[1]}"' if b[1] not in (None, 1) else ""
    items = "".join("<li>" + ("\n" if b[2] and x else "") + "".join(_block(y, not b[2]) for y in x).removesuffix("\n" if not b[2] and x and x[-1][0] == "p" else "\0") + "</li>\n" for x in b[3])
    return f"<{tag}{start}>\n{items}</{tag}>\n"


def spans(text: str) -> str:
    """A text with its spans marked up, and straight quotes made round."""
    out: list = []  # strings, and delimiter runs as [sign, length, may open, may close]
    opened: list[tuple[int, bool]] = []
    at = 0
    while at < len(text):
        m = SPAN.match(text, at)
        end, kind = m.end(), m.lastgroup
        if m["code"]:
            inner = m["inner"].replace("\n", " ")
            inner = inner[1:-1] if inner.strip() and inner[0] == inner[-1] == " " else inner
            out.append(f"<code>{escape(inner, quote=False)}</code>")
        elif kind == "escape":
            out.append(escape(m[0][1], quote=False))
        elif kind == "auto":
            out.append(f'<a href="{escape(m[0][1:-1])}">{escape(m[0][1:-1], quote=False)}</a>')
        elif kind in ("raw", "entity"):
            out.append(m[0])
        elif kind == "break":
            out.append("<br />\n")
        elif kind in ("image", "open"):
            opened.append((len(out), kind == "image"))
            out.append(m[0])
        elif kind == "close" and opened:
            place, image = opened.pop()
            target = TARGET.match(text, end)
            if target:
                end = target.end()
                href = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", target[1] if target[1] is not None else target[2])
                title = next((f' title="{escape(t)}"' for t in target.group(3, 4) if t), "")
                inner = _paired(out[place + 1 :])
                if image:
                    made = f'<img src="{escape(href)}" alt="{escape(re.sub("<[^>]+>", "", inner), quote=True).replace("&amp;", "&")}"{title} />'
                else:
                    made = f'<a href="{escape(href)}"{title}>{inner}</a>'
                    opened = [o for o in opened if o[1]]  # links hold no links
                out[place:] = [made]
            else:
                out.append("]")
        elif kind == "run":
            before, after = text[at - 1 : at] or " ", text[end : end + 1] or " "
            mark = lambda c: not c.isalnum() and not c.isspace()
            left = not after.isspace() and (not mark(after) or before.isspace() or mark(before))
            right = not before.isspace() and (not mark(before) or after.isspace() or mark(after))
            sign = m[0][0]
            out.append([sign, len(m[0]), left and (sign != "_" or not right or mark(before)), right and (sign != "_" or not left or mark(after))])
        else:
            out.append(_round(m[0], text[at - 1 : at]))
        at = end
    return _paired(out)


def _round(piece: str, before: str) -> str:
    """Text with straight quotes made round."""
    out, last = [], before or " "
    for c in piece:
        if c in "\"'":
            opens = last.isspace() or last in "([{“‘-–—"
            out.append(("“" if opens else "”") if c == '"' else ("‘" if opens else "’"))
        else:
            out.append(escape(c, quote=False))
        last = c
    return "".join(out)


def _paired(tokens: list) -> str:
    """Tokens as markup: each closing run takes the nearest run of its sign that may open."""
    parts = [list(t) if isinstance(t, list) else t for t in tokens]
    before: list[list[str]] = [[] for _ in parts]  # end tags in front of what is left of a run
    after: list[list[str]] = [[] for _ in parts]  # start tags behind it
    waiting: list[int] = []
    for k, run in enumerate(parts):
        if not isinstance(run, list):
            continue
        while run[3] and run[1]:
            place = next((j for j in reversed(waiting) if parts[j][0] == run[0] and not ((parts[j][3] or run[2]) and run[0] != "~" and (tokens[j][1] + tokens[k][1]) % 3 == 0 and tokens[j][1] % 3)), None)
            if place is None:
                break
            waiting = [j for j in waiting if j <= place]
            n = 2 if run[0] == "~" or min(run[1], parts[place][1]) >= 2 else 1
            tag = "del" if run[0] == "~" else "strong" if n == 2 else "em"
            after[place].insert(0, f"<{tag}>")
            before[k].append(f"</{tag}>")
            run[1] -= n
            parts[place][1] -= n
            if not parts[place][1]:
                waiting.remove(place)
        if run[2] and run[1]:
            waiting.append(k)
    return "".join("".join(before[k]) + (p[0] * p[1] if isinstance(p, list) else p) + "".join(after[k]) for k, p in enumerate(parts))
