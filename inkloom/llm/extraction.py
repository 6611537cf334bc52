"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks.  A block's input is the mean vector of its hashed
tag-path features, the mean vector of its hashed words and a few measures; a
bidirectional LSTM in numpy reads the whole sequence, and each block is labelled main
text or not with that context.  The model is trained on the driver on pages made from a
grammar of layouts, so it needs no labels, and on a bounded sample of the table's own
pages whose blocks stand in elements that state their role.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import arrow_slices, drawn, texts_of, tidied
from inkloom.llm.markup import Block, blocks_of

PATH_ROWS, WORD_ROWS, PATH_SIZE, WORD_SIZE, HIDDEN_SIZE = 2048, 1024, 24, 8, 20
MEASURES = 8
#: Words that mark the places where menus, notices and the like stand: rules for weak labels and names for the grammar.
ASIDE_NAMES = "ad ads advert advertisement sponsored promo banner cookie consent notice alert sidebar widget related share social breadcrumb breadcrumbs menu nav navbar navigation footer header masthead comments comment comment-list discussion responses newsletter subscribe login search pagination toolbar popup modal copyright".split()
MAIN_NAMES = "content article article-body post post-content entry-content story main body-text text".split()
WORD = re.compile(r"\w+")


class Rows(dict):
    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, key: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        out = self[key] = zlib.crc32(key.encode()) % self.size
        return out


_PATHS, _WORDS = Rows(PATH_ROWS), Rows(WORD_ROWS)


def forget_rows() -> None:
    _PATHS.clear()
    _WORDS.clear()


def path_features(block: Block) -> list[int]:
    tags = [t for t, _ in block.path]
    out = [f"t:{t}" for t in tags] + [f"c:{w}" for _, names in block.path for n in names for w in (n, *re.split(r"[-_]", n))]
    out.append("leaf:" + ">".join(tags[-2:]))
    return [_PATHS[x] for x in out]


def measures(block: Block, i: int, n: int) -> list[float]:
    t = block.text
    return [
        np.log1p(len(t)) / 6,
        block.linked / (len(t) + 1) if block.linked < len(t) else 1.0,
        min(1.0, sum(map(t.count, ".,;!?")) / (1 + 0.1 * len(t))),
        i / max(1, n - 1),
        float("©" in t or "\xa9" in t),
        t.count(" ") / (len(t) + 1) * 4,
        float(i == 0),
        float(t[-1:] in ".!?"),
    ]


@dataclass
class Page:
    paths: list[list[int]]
    words: list[list[int]]
    numbers: np.ndarray


def read(blocks: list[Block]) -> Page:
    n = len(blocks)
    return Page([path_features(b) for b in blocks], [[_WORDS[w] for w in WORD.findall(b.text.lower())] for b in blocks], np.array([measures(b, i, n) for i, b in enumerate(blocks)], "f4").reshape(n, MEASURES))


def _mean(table: np.ndarray, lists: list[list[int]]) -> np.ndarray:
    sizes = np.array([len(x) for x in lists], "i8")
    flat = np.fromiter((i for x in lists for i in x), "i8", int(sizes.sum()))
    total = np.zeros((len(lists), table.shape[1]), "f4")
    if len(flat):
        first = np.cumsum(sizes) - sizes
        filled = sizes > 0
        total[filled] = np.add.reduceat(table[flat], first[filled], axis=0)
    return total / np.maximum(1, sizes)[:, None]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + MEASURES
        normal = lambda *shape, by=1.0: (rng.normal(size=shape) * by).astype("f4")
        self.w = {"path": normal(PATH_ROWS, PATH_SIZE, by=0.3), "word": normal(WORD_ROWS, WORD_SIZE, by=0.1), "out": normal(2 * HIDDEN_SIZE + size, by=0.1), "bias": np.zeros(1, "f4")}
        for way in "fb":
            self.w["x" + way] = normal(size, 4 * HIDDEN_SIZE, by=size**-0.5)
            self.w["h" + way] = normal(HIDDEN_SIZE, 4 * HIDDEN_SIZE, by=HIDDEN_SIZE**-0.5)
            b = np.zeros(4 * HIDDEN_SIZE, "f4")
            b[HIDDEN_SIZE : 2 * HIDDEN_SIZE] = 1
            self.w["b" + way] = b

    def inputs(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
        """Time x page x input, and which cells hold a block."""
        steps = max(len(p.paths) for p in pages)
        flat = np.concatenate([_mean(self.w["path"], [x for p in pages for x in p.paths]), _mean(self.w["word"], [x for p in pages for x in p.words]), np.concatenate([p.numbers for p in pages])], 1)
        x = np.zeros((len(pages), steps, flat.shape[1]), "f4")
        mask = np.arange(steps) < np.array([len(p.paths) for p in pages])[:, None]
        x[mask] = flat
        return x.transpose(1, 0, 2), mask.T

    def _pass(self, x, mask, way, keep):
        steps, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN_SIZE), "f4"), np.zeros((n, HIDDEN_SIZE), "f4")
        out, kept = np.zeros((steps, n, HIDDEN_SIZE), "f4"), []
        pre = x @ self.w["x" + way] + self.w["b" + way]
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = pre[t] + h @ self.w["h" + way]
            i, f, o = (sigmoid(z[:, k * HIDDEN_SIZE : (k + 1) * HIDDEN_SIZE]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN_SIZE :])
            m = mask[t][:, None]
            c_new = np.where(m, f * c + i * g, c)
            th = np.tanh(c_new)
            h_new = np.where(m, o * th, h)
            if keep:
                kept.append((t, h, c, i, f, o, g, th, m))
            h, c = h_new, c_new
            out[t] = h
        return out, kept

    def scores(self, pages: list[Page]) -> list[np.ndarray]:
        """Log odds of every block of every page."""
        x, mask = self.inputs(pages)
        hf, hb = self._pass(x, mask, "f", False)[0], self._pass(x, mask, "b", False)[0]
        z = np.concatenate([hf, hb, x], 2) @ self.w["out"] + self.w["bias"]
        return [z[: len(p.paths), k] for k, p in enumerate(pages)]

    def gradients(self, pages: list[Page], labels: list[np.ndarray]) -> tuple[float, dict]:
        x, mask = self.inputs(pages)
        (hf, kf), (hb, kb) = self._pass(x, mask, "f", True), self._pass(x, mask, "b", True)
        joined = np.concatenate([hf, hb, x], 2)
        p = sigmoid(joined @ self.w["out"] + self.w["bias"])
        y = np.zeros(mask.shape, "f4")
        for k, lab in enumerate(labels):
            y[: len(lab), k] = lab
        n = max(1, mask.sum())
        loss = -float((np.log(np.where(y > 0, p, 1 - p) + 1e-7) * mask).sum() / n)
        dz = ((p - y) * mask / n).astype("f4")
        g = {"out": np.einsum("tnd,tn->d", joined, dz), "bias": np.array([dz.sum()], "f4")}
        dj = dz[:, :, None] * self.w["out"]
        dx = dj[:, :, 2 * HIDDEN_SIZE :].copy()
        for way, kept, dh_all in (("f", kf, dj[:, :, :HIDDEN_SIZE]), ("b", kb, dj[:, :, HIDDEN_SIZE : 2 * HIDDEN_SIZE])):
            wx, wh = self.w["x" + way], self.w["h" + way]
            gx, gh, gb = np.zeros_like(wx), np.zeros_like(wh), np.zeros_like(self.w["b" + way])
            dh, dc = np.zeros_like(hf[0]), np.zeros_like(hf[0])
            for t, h, c, i, f, o, gg, th, m in reversed(kept):
                dh = dh + dh_all[t]
                dhm = np.where(m, dh, 0)
                dcm = np.where(m, dc, 0) + dhm * o * (1 - th * th)
                d = np.concatenate([dcm * gg * i * (1 - i), dcm * c * f * (1 - f), dhm * th * o * (1 - o), dcm * i * (1 - gg * gg)], 1)
                gx += x[t].T @ d
                gh += h.T @ d
                gb += d.sum(0)
                dx[t] += d @ wx.T
                dh = np.where(m, d @ wh.T, dh)
                dc = np.where(m, dcm * f, dc)
            g["x" + way], g["h" + way], g["b" + way] = gx, gh, gb
        flat = dx.transpose(1, 0, 2)[mask.T]
        for name, lists, part in (("path", [q for p in pages for q in p.paths], flat[:, :PATH_SIZE]), ("word", [q for p in pages for q in p.words], flat[:, PATH_SIZE : PATH_SIZE + WORD_SIZE])):
            sizes = np.array([len(q) for q in lists], "i8")
            rows = np.fromiter((i for q in lists for i in q), "i8", int(sizes.sum()))
            gt = np.zeros_like(self.w[name])
            np.add.at(gt, rows, np.repeat(part / np.maximum(1, sizes)[:, None], sizes, axis=0))
            g[name] = gt
        return loss, g

    def fit(self, data: list[tuple[Page, np.ndarray]], epochs: int = 6, batch: int = 24, rate: float = 0.01, seed: int = 5) -> list[float]:
        rng = np.random.default_rng(seed)
        first, second, losses, step = {k: np.zeros_like(v) for k, v in self.w.items()}, {k: np.zeros_like(v) for k, v in self.w.items()}, [], 0
        data = sorted((d for d in data if d[0].paths), key=lambda d: len(d[0].paths))
        groups = [data[i : i + batch] for i in range(0, len(data), batch)]
        for epoch in range(epochs):
            total = 0.0
            for k in rng.permutation(len(groups)):
                pages = [_thinned(p, rng) for p, _ in groups[k]]
                loss, g = self.gradients(pages, [y for _, y in groups[k]])
                total += loss
                step += 1
                for name, grad in g.items():
                    grad = np.clip(grad, -1, 1)
                    first[name] = 0.9 * first[name] + 0.1 * grad
                    second[name] = 0.99 * second[name] + 0.01 * grad * grad
                    fair1, fair2 = 1 - 0.9**step, 1 - 0.99**step
                    self.w[name] -= rate * (0.5 if epoch > epochs // 2 else 1) * (first[name] / fair1) / (np.sqrt(second[name] / fair2) + 1e-8)
            losses.append(total / max(1, len(groups)))
        return losses


def _thinned(page: Page, rng) -> Page:
    """A page without some of its path features, so that no single name decides."""
    return Page([[i for i in x if rng.random() > 0.12] for x in page.paths], page.words, page.numbers)


def weak_labels(blocks: list[Block]) -> np.ndarray | None:
    """Labels from elements that state their role; None if a page has no such main element."""
    out, main = [], False
    for b in blocks:
        inside, beside = False, False
        for tag, names in b.path:
            words = {w for n in names for w in (n, *re.split(r"[-_]", n))}
            inside |= tag in ("article", "main")
            beside |= tag in ("nav", "aside", "footer", "form", "button") or bool(words & _ASIDE)
        main |= inside
        out.append(inside and not beside)
    return np.array(out, "f4") if main else None


_ASIDE = frozenset(ASIDE_NAMES)


def made_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page of a random layout and the texts of its main blocks."""
    syllables = [rng.choice("bcdfghklmnprstvw") + rng.choice("aeiouéü") + rng.choice(["", "n", "s", "r"]) for _ in range(60)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    count = [0]

    def words(lo, hi, stop=True):
        n = rng.randint(lo, hi)
        count[0] += 1
        body = " ".join(w + rng.choice(["", "", "", "", ",", "."]) for w in (word() for _ in range(n - 1)))
        return (body + " " + word()).strip().capitalize() + f" {word()}{count[0]}" + ("." if stop else "")

    name = lambda pool: rng.choice(pool) if rng.random() < 0.8 else rng.choice(pool) + rng.choice(["-box", "-wrap", "_1", "-area"])
    attr = lambda pool: f' {rng.choice(["class", "class", "id"])}="{name(pool)}"'
    main: set[str] = set()

    def links(n):
        return "".join(f'<li><a href="/{word()}">{words(1, 2, False)}</a></li>' for _ in range(n))

    def box(tag, pool, inner):
        return f"<{tag}{attr(pool) if pool and (tag == 'div' or rng.random() < 0.4) else ''}>{inner}</{tag}>"

    def kept(lo, hi, stop=True):
        t = words(lo, hi, stop)
        main.add(t)
        return t

    def paragraph():
        t = kept(3, rng.choice([8, 30, 120]))
        kind = rng.random()
        if kind < 0.12:
            return f"<p><b>{t}<br>"
        if kind < 0.2:
            return f"<p>{t}"
        if kind < 0.3 and " " in t:
            a, b = t.split(" ", 1)
            return f'<p>{a} <a href="/{word()}">{b}</a></p>' if len(b) < 40 else f"<p><em>{a}</em> {b}</p>"
        return f"<p>{t}</p>"

    def content():
        out = [f"<h1>{kept(2, 9, False)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice([0, 1, 2, 4, 8, 14])):
            r = rng.random()
            if r < 0.72:
                out.append(paragraph())
            elif r < 0.8:
                out.append(f"<h2>{kept(1, 6, False)}</h2>")
            elif r < 0.87:
                out.append("<ul>" + "".join(f"<li>{kept(2, 15)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif r < 0.91:
                out.append(f"<blockquote>{kept(5, 25)}</blockquote>")
            elif r < 0.95:
                out.append(box("div", ["share", "social", "ad", "advert", "newsletter", "related", "promo"], rng.choice([words(2, 12), f"<p>{words(2, 20)}</p>", f"<ul>{links(3)}</ul>"])))
            else:
                out.append(f"<table><tr><th>{kept(1, 2, False)}</th><td>{kept(1, 4, False)}</td></tr></table>")
        if not main:
            out.append(f"<p>{kept(5, 40)}</p>")
        return "".join(out)

    menu = lambda: rng.choice([lambda: box("nav", ["menu", "nav"], f"<ul>{links(rng.randint(2, 8))}</ul>"), lambda: box("div", ["menu", "navbar", "navigation", "breadcrumb"], rng.choice([f"<ul>{links(5)}</ul>", f'<a href="/">{words(1, 2, False)}</a> | <a href="/x">{words(1, 2, False)}</a>']))])()
    note = lambda: box(rng.choice(["div", "div", "aside", "section"]), ["ad", "ads", "advert", "sponsored", "promo", "banner", "cookie", "consent", "notice", "alert", "cookie-notice", "popup"], rng.choice([words(3, 25), f"<p>{words(3, 30)}</p><button>{words(1, 2, False)}</button>"]))
    side = lambda: box(rng.choice(["aside", "div"]), ["sidebar", "widget", "related", "social"], f"<h3>{words(1, 4, False)}</h3>" + rng.choice([f"<ul>{links(4)}</ul>", f"<p>{words(4, 30)}</p>"]))
    form = lambda: box("form", ["search", "login", "newsletter", "subscribe"], f"<label>{words(1, 3, False)}</label><input name=q><button>{words(1, 2, False)}</button>" + (f"<p>{words(3, 15)}</p>" if rng.random() < 0.5 else ""))
    said = lambda: box(rng.choice(["div", "section", "ol"]), ["comments", "comment-list", "discussion", "responses", "comment"], (f"<h2>{words(1, 3, False)}</h2>" if rng.random() < 0.6 else "") + "".join(box(rng.choice(["div", "li", "article"]), ["comment", "comment", "reply", "comment-body"], f"<p>{words(4, 50)}</p>") for _ in range(rng.randint(1, 4))))
    head = box(rng.choice(["header", "div"]), ["header", "masthead", "site-header", "top"], rng.choice([words(1, 6, False), f"<h2>{words(1, 4, False)}</h2><p>{words(3, 10)}</p>"]) + (menu() if rng.random() < 0.4 else ""))
    foot = box(rng.choice(["footer", "footer", "div"]), ["footer", "copyright", "site-footer"], rng.choice([f"&copy; {words(2, 20)}", f"<p>{words(3, 25)}</p>", f"<ul>{links(4)}</ul><p>&copy; {words(1, 5)}</p>"]))
    before = [f() for f in (menu, note, side, form) if rng.random() < 0.45]
    after = [f() for f in (note, side, form, said) if rng.random() < 0.4]
    body = content()
    kind = rng.random()
    if kind < 0.5:
        body = box("article", ["post", "article"], body)
    elif kind < 0.65:
        body = box("main", ["content", "main"], body)
    elif kind < 0.95:
        body = box("div", MAIN_NAMES, body)
    page = ("" if rng.random() < 0.45 else head) + "".join(before) + body + "".join(after) + ("" if rng.random() < 0.15 else foot)
    if rng.random() < 0.3:
        page = f'<div class="{rng.choice(["page", "wrapper", "container", "site"])}">{page}</div>'
    return f"<html><head><title>{word()}</title></head><body>{page}</body></html>", main


def training_pages(count: int, seed: int = 11) -> list[tuple[Page, np.ndarray]]:
    rng, out = random.Random(seed), []
    for _ in range(count):
        page, main = made_page(rng)
        blocks = blocks_of(page)
        out.append((read(blocks), np.array([b.text in main for b in blocks], "f4")))
    return out


def train(sample: list[str], made: int = 900) -> Labeller:
    """A labeller fitted on `made` pages of the grammar and on the sample's pages that state their roles."""
    data = training_pages(made)
    for page in sample:
        blocks = blocks_of(page)
        labels = weak_labels(blocks) if blocks else None
        if labels is not None:
            data.append((read(blocks), labels))
    model = Labeller()
    model.fit(data)
    return model


def extract(model: Labeller, pages: list[str]) -> list[str]:
    """The main text of every page; pages without blocks, and empty ones, give an empty text."""
    out = [""] * len(pages)
    blocks = [blocks_of(p) for p in pages]
    order = sorted((i for i in range(len(pages)) if blocks[i]), key=lambda i: len(blocks[i]))
    at = 0
    while at < len(order):
        group = order[at : at + max(1, min(256, 40_000 // len(blocks[order[at]])))]
        group = [i for i in group if len(blocks[i]) <= 2 * len(blocks[group[0]]) + 8]
        at += len(group)
        for i, z in zip(group, model.scores([read(blocks[i]) for i in group])):
            out[i] = "\n".join(b.text for b, s in zip(blocks[i], z) if s > 0)
    return out


def main_text(pages: DataFrame, sample_pages: int = 300) -> DataFrame:
    """page_id, url, text and n_chars of every page (page_id, url, html).

    The model is trained on the driver, on at most about sample_pages of the table's
    distinct pages (`drawn`: of a bounded length).  Null
    and empty pages, and pages without main text, give an empty text.  Whole pages are
    read, whatever their length; rows are independent, so repeated rows and null keys
    need no care; other columns are not read.  An empty table gives no rows.
    """
    total = pages.count()
    sample = [r["html"] for r in drawn(pages.select("html"), min(1.0, sample_pages / max(1, total)), 37, "html").collect()] if total else []
    shared = pages.sparkSession.sparkContext.broadcast(train(sorted(sample)) if total else None)

    def run(batches):
        for b in arrow_slices(batches, "html", 4 << 20):
            texts = extract(shared.value, texts_of(b.column("html")))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(tidied(run, forget_rows), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
