"""HTML pages as tables of facts and of block texts. The tokenizer is the standard library's, as markup need not be well formed."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = (*HEADINGS, "p", "li", "td", "figcaption", "blockquote")
#: What a block ends that its author left open.
CLOSES = {"p": ("p",), "li": ("p", "li"), "td": ("p", "td"), "blockquote": ("p",), "figcaption": ("p",)} | {h: ("p",) for h in HEADINGS}
ASIDE = ("script", "style", "nav", "footer", "aside", "form", "noscript", "header")
#: References to characters by more digits than Python reads as a number.
LONG_REFERENCE = re.compile(r"&#([0-9]{4000,})")


class Facts(HTMLParser):
    """Rows (kind, line, level, value, extra, role) of a page, and its block texts in the order in which they begin."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.blocks: list[tuple[str, list[str], bool]] = []
        self.heading: tuple[int, int, list[str]] | None = None
        self.body = self.hidden = False
        self.length = 0
        self.open: list[tuple[str, int]] = []
        self.aside = 0
        self.main = 0

    def handle_starttag(self, tag, attrs):
        line, named = self.getpos()[0], dict(attrs)
        self.body |= tag == "body"
        self.hidden |= tag in ("script", "style")
        self.aside += tag in ASIDE
        self.main += tag in ("article", "main")
        if named.get("id") is not None:
            self.rows.append(("id", line, None, named["id"], None, None))
        if tag == "a" and named.get("href") is not None:
            self.rows.append(("href", line, None, named["href"], None, None))
        if tag == "img":
            self.rows.append(("image", line, None, named.get("alt"), named.get("src"), named.get("role")))
        if tag in HEADINGS:
            self.heading = (int(tag[1]), line, [])
        if tag in BLOCKS:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in CLOSES[tag]:
                    del self.open[i:]
                    break
            self.blocks.append((tag, [], not self.aside and bool(self.main)))
            self.open.append((tag, len(self.blocks) - 1))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in BLOCKS or tag in ASIDE or tag in ("article", "main"):
            self._close(tag)

    def _close(self, tag):
        self.aside -= tag in ASIDE and self.aside > 0
        self.main -= tag in ("article", "main") and self.main > 0
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag or tag in HEADINGS and self.open[i][0] in HEADINGS:
                del self.open[i:]
                break

    def handle_endtag(self, tag):
        self.body &= tag != "body"
        self.hidden &= tag not in ("script", "style")
        if tag in HEADINGS and self.heading:
            level, line, parts = self.heading
            self.rows.append(("heading", line, level, "".join(parts).strip(), None, None))
            self.heading = None
        self._close(tag)

    def handle_data(self, data):
        if self.heading:
            self.heading[2].append(data)
        if self.hidden:
            return
        if self.body:
            self.length += len(data.strip())
        for _, i in self.open:
            self.blocks[i][1].append(data)

    def parse_marked_section(self, i, report=1):
        """A section of no known name ends at the next '>', as a comment does; the base class reads no further than such a one."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)


def parsed(page: str | None) -> Facts:
    """The facts of a whole page; a fault is raised, as what was read before it would look like a page."""
    facts = Facts()
    # (zeros ahead say nothing, and eight digits are beyond the last character)
    facts.feed(LONG_REFERENCE.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), page or ""))
    facts.close()
    return facts


def html_facts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, kind, line, level, value, src, role): ids, hrefs, images, headings, and one row `body` with the text length as level."""
    kind = dict(pages.dtypes)[key]

    def run(batches):
        for b in batches:
            out = []
            for k, page in zip(b[key], b[html]):
                f = parsed(page)
                out += [(k, *r) for r in f.rows] + [(k, "body", None, f.length, None, None, None)]
            yield pd.DataFrame(out, columns=[key, "kind", "line", "level", "value", "src", "role"]).astype({"line": "Int32", "level": "Int32"})

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, kind string, line int, level int, value string, src string, role string")


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, block, tag, text, main): block texts in document order; a block within a block is repeated in it."""
    kind = dict(pages.dtypes)[key]

    def run(batches):
        for b in batches:
            out = []
            for k, page in zip(b[key], b[html]):
                texts = [(tag, " ".join("".join(parts).split()), main) for tag, parts, main in parsed(page).blocks]
                out += [(k, i, *x) for i, x in enumerate(t for t in texts if t[1])]
            yield pd.DataFrame(out, columns=[key, "block", "tag", "text", "main"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, block int, tag string, text string, main boolean")


def main_content(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(key, url, title, content): the blocks of a page's article as markdown; the title is the page's first heading, else its address."""
    blocks = html_blocks(pages, key, html).where("main")
    marked = F.when(F.col("tag").rlike("^h[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int")), F.lit(" "), F.col("text"))).when(F.col("tag") == "li", F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    body = blocks.withColumn("md", marked).groupBy(key).agg(F.expr("listagg(md, '\\n\\n') WITHIN GROUP (ORDER BY block)").alias("content"), F.min_by("text", F.when(F.col("tag").rlike("^h[1-6]$"), F.col("block"))).alias("title"))
    return pages.select(key, url).join(body, key, "left").select(key, url, F.coalesce("title", url).alias("title"), F.coalesce("content", F.lit("")).alias("content"))
