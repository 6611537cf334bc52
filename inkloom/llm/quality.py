"""Document quality by co-training of a text view and a metadata view.

The text view is the shares of hashed words and of hashed token shapes (letters, capitals,
digits and other characters, runs as one) and a few measures of the text; the metadata
view is the language, the source and the recorded length.  Each view has a logistic regression.  In
every round each labels the unlabelled rows it is surest of for the other, which is then
fitted again.  The two log odds are calibrated together on labelled rows kept aside, and
the threshold is set there so that almost no good document falls below it.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import arrow_slices, drawn, texts_of, tidied

SHAPES, WORDS = 512, 512
TEXT_SIZE = SHAPES + WORDS + 10
LANG_ROWS, SOURCE_ROWS, LENGTH_ROWS = 32, 128, 20
META_SIZE = LANG_ROWS + SOURCE_ROWS + LENGTH_ROWS

RUNS = [(re.compile(p), by) for p, by in ((r"[^\W\d_a-z]*[A-ZÀ-ÖØ-Þ]{2,}[^\W\d_a-z]*", "U"), (r"[^\W\d_]+", "a"), (r"\d+", "9"), (r"(.)\1+", r"\1\1"))]


def shape(token: str) -> str:
    """A token with words, numbers and runs of one character made alike."""
    for pattern, by in RUNS:
        token = pattern.sub(by, token)
    return token[:24]


class ShapeRows(dict):
    """A token's shape and word rows as one number."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        out = zlib.crc32(shape(token).encode()) % SHAPES * WORDS + zlib.crc32(token.lower().encode()) % WORDS
        if len(token) <= 64:
            self[token] = out
        return out


_ROWS = ShapeRows()


def forget_tokens() -> None:
    _ROWS.clear()


def text_view(text: str) -> np.ndarray:
    out = np.zeros(TEXT_SIZE, "f4")
    tokens = text.split()
    if not tokens:
        return out
    n = len(tokens)
    rows = np.fromiter(map(_ROWS.__getitem__, tokens), "i8", n)
    out[:SHAPES] = np.sqrt(np.bincount(rows // WORDS, minlength=SHAPES) / n)
    out[SHAPES : SHAPES + WORDS] = np.sqrt(np.bincount(rows % WORDS, minlength=WORDS) / n)
    lines, chars = text.count("\n") + 1, len(text)
    letters = sum(map(str.isalpha, tokens))
    distinct = len(set(tokens))
    out[SHAPES + WORDS :] = [
        math.log1p(n) / 8, chars / n / 12, letters / n, distinct / n, min(3.0, n / lines / 20), sum(map(text.count, ".,;:")) / n,
        sum(map(str.isupper, tokens)) / n, sum(map(text.count, "!?*#$%&|")) / n, sum(map(text.count, "0123456789")) / chars, 1.0,
    ]
    return out


def meta_view(lang, source, n_chars) -> np.ndarray:
    out = np.zeros(META_SIZE, "f4")
    row = lambda value, rows: zlib.crc32(str(value).encode()) % rows
    out[row(lang, LANG_ROWS)] = 1
    out[LANG_ROWS + row(source, SOURCE_ROWS)] = 1
    size = 0 if n_chars is None else min(LENGTH_ROWS - 1, 1 + int(math.log2(1 + max(0, n_chars))))
    out[LANG_ROWS + SOURCE_ROWS + size] = 1
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 250) -> np.ndarray:
    """Logistic regression (last entry: bias) by accelerated gradient descent."""
    x = np.concatenate([x, np.ones((len(x), 1), "f4")], 1)
    weight, y = weight.astype("f4"), y.astype("f4")
    w = np.zeros(x.shape[1], "f4")
    look, pace = w.copy(), 1.0
    rate = 4 / max(1e-9, float(np.einsum("ij,ij,i->", x, x, weight) / weight.sum()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ look, -40, 40)))
        new = look - rate * (x.T @ (weight * (p - y)) / weight.sum() + ridge * look * np.r_[np.ones(len(w) - 1, "f4"), np.float32(0)])
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        look = new + np.float32((pace - 1) / faster) * (new - w)
        w, pace = new, faster
    return w


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


@dataclass
class CoTrained:
    text: np.ndarray
    meta: np.ndarray
    final: np.ndarray  # weights of the two log odds, and bias
    threshold: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = odds(text, self.text), odds(meta, self.meta)
        joined = odds(np.stack([a, b], 1), self.final)
        return tuple(1 / (1 + np.exp(-np.clip(z, -40, 40))) for z in (a, b, joined))


def co_train(text: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int = 4, share: float = 0.1, sure: float = 0.9, lost: float = 0.002) -> CoTrained:
    """label: 1 good, 0 bad, -1 unknown.  Every fourth labelled row is kept for calibration.

    In a round each view gives the other up to `share` of the unlabelled rows of each
    label, those it is surest of and at least `sure`.  The threshold lies below all but
    `lost` of the good calibration rows, and not above one half.
    """
    known = np.flatnonzero(label >= 0)
    aside = known[::4] if len(known) >= 40 else known
    own = np.setdiff1d(known, aside) if len(known) >= 40 else known
    pool = np.flatnonzero(label < 0)
    views, given = [text, meta], [{}, {}]
    models: list = [None, None]
    for turn in range(rounds + 1):
        for v in (0, 1):
            rows = np.concatenate([own, np.array(sorted(given[v]), "i8")])
            y = np.concatenate([label[own], np.array([given[v][i] for i in sorted(given[v])])]).astype("f8")
            weight = np.concatenate([np.ones(len(own)), np.full(len(given[v]), 0.5)])
            for k in (0, 1):  # both labels weigh the same
                weight[y == k] /= max(1e-9, weight[y == k].sum())
            models[v] = fit(views[v][rows], y, weight)
        if turn == rounds or not len(pool):
            break
        for v in (0, 1):
            p = 1 / (1 + np.exp(-np.clip(odds(views[v][pool], models[v]), -40, 40)))
            most = max(1, int(share * len(pool)))
            for k, conf in ((1, p), (0, 1 - p)):
                for i in np.argsort(-conf, kind="stable")[:most]:
                    if conf[i] >= sure:
                        given[1 - v].setdefault(int(pool[i]), k)
    a = np.stack([odds(text[aside], models[0]), odds(meta[aside], models[1])], 1)
    y = label[aside].astype("f8")
    final = fit(np.clip(a, -20, 20), y, np.ones(len(y)), ridge=1e-4, steps=400) if 0 < y.mean() < 1 else np.array([1.0, 0.0, 0.0])
    p = np.sort((1 / (1 + np.exp(-np.clip(odds(a, final), -40, 40))))[y > 0.5])
    threshold = min(0.5, float(p[int(lost * len(p))])) if len(p) else 0.0
    return CoTrained(models[0], models[1], final, threshold * 0.999)


def train_on(docs: DataFrame, labels: DataFrame, labelled: int = 4000, unlabelled: int = 4000) -> CoTrained | None:
    """A model from about `labelled` labelled documents, chosen by a hash of doc_id, and `unlabelled` others (`drawn`); None without labels of both kinds.

    Of rows that repeat a doc_id the one with the smallest text is learnt from, and texts
    of more than 200,000 characters are not.  What is labelled here, the rows kept for
    calibration among them, is not in the pool.
    """
    kinds = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    counts = kinds.agg(F.count("*").alias("n"), F.min("_quality").alias("lo"), F.max("_quality").alias("hi")).first()
    if not counts["n"] or counts["lo"] == counts["hi"]:
        return None
    total = docs.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    some = kinds.where(draw < min(1.0, labelled / counts["n"]))
    rest = ["text", "lang", "source", "n_chars"]
    read = docs.select("doc_id", *rest).where((F.length("text") <= 200_000) | F.col("text").isNull())
    known = read.where(draw < min(1.0, labelled / counts["n"])).join(some, "doc_id").groupBy("doc_id", "_quality").agg(F.min(F.struct(*rest)).alias("r"))
    known = known.select("doc_id", "r.*", F.when(F.col("_quality") > 0, 1).otherwise(0).alias("_label"))
    # (a hash of its own for the pool: what is labelled and not drawn above serves as unlabelled)
    pool = drawn(read, min(1.0, unlabelled / max(1, total)), 29).join(some.select("doc_id"), "doc_id", "left_anti").withColumn("_label", F.lit(-1))
    columns = ["doc_id", *rest, "_label"]
    rows = known.select(columns).unionByName(pool.select(columns))

    def view(batches):
        for b in arrow_slices(batches, "text"):
            t, m = _views(b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_label"), pa.array([x.tobytes() for x in t], pa.binary()), pa.array([x.tobytes() for x in m], pa.binary())], names=["doc_id", "label", "t", "m"])

    got = rows.mapInArrow(tidied(view, forget_tokens), f"doc_id {dict(docs.dtypes)['doc_id']}, label int, t binary, m binary").collect()
    got = sorted(got, key=lambda r: (r["label"], r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["t"])))
    label = np.array([r["label"] for r in got])
    if not {0, 1} <= set(label.tolist()):
        return None
    return co_train(np.stack([np.frombuffer(r["t"], "f4") for r in got]), np.stack([np.frombuffer(r["m"], "f4") for r in got]), label)


def _views(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = np.stack([text_view(t) for t in texts_of(b.column("text"))])
    meta = np.stack([meta_view(*x) for x in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")))])
    return text, meta


def score_quality(docs: DataFrame, labels: DataFrame, labelled: int = 4000, unlabelled: int = 4000) -> DataFrame:
    """docs with text_score, meta_score, score (all 0 to 1) and accepted.

    All columns of docs stay, but for those named as the four above, which are replaced;
    docs has doc_id, text, lang, source and n_chars.  Null text
    is scored as empty, null metadata as a value of its own; a null doc_id is scored but
    never learnt from.  Repeated labels of a document: the best holds.  Repeated rows are
    scored alike.  Without labels of both kinds scores are 0.5 and all is accepted.  An
    empty table gives no rows.
    """
    docs = docs.drop("text_score", "meta_score", "score", "accepted", "_label", "_quality")
    model = train_on(docs, labels, labelled, unlabelled)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "text_score double, meta_score double, score double, accepted boolean"])

    def run(batches):
        m = shared.value
        for b in arrow_slices(batches, "text"):
            a = c = s = np.full(b.num_rows, 0.5)
            if m:
                a, c, s = (x.astype("f8") for x in m.score(*_views(b)))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(a), pa.array(c), pa.array(s), pa.array(s >= (m.threshold if m else 0.0))], names=[*names, "text_score", "meta_score", "score", "accepted"])

    return docs.mapInArrow(tidied(run, forget_tokens), schema)
