"""Language identification by prediction by partial matching.

Every language has a byte context tree of variable order with frozen counts.  A byte's
probability in a context is its share among the context's counts; an unseen byte pays
the context's escape probability, distinct / (total + distinct), and is sought in the
next shorter context, down to a uniform order -1.  A context that a language never saw
costs nothing to leave.  The trees of all languages are compiled into tables by order:
a context's number, the code lengths of the bytes that some language saw in it, and what
it costs to leave it.  Texts are scored exactly by table look-ups, all bytes of a block
at once, from the longest contexts down.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import arrow_slices, drawn, texts_of, tidied

LETTER = regex.compile(r"\p{L}")


@dataclass
class ContextModel:
    """Of each order: slot (context code -> number or -1), entry (number x byte -> row of bits or -1), bits (row x language) and escape (number x language)."""

    languages: list[str]
    order: int
    symbol: np.ndarray  # byte -> column; 0 holds the bytes never seen
    width: int
    slot: list[np.ndarray]
    entry: list[np.ndarray]
    bits: list[np.ndarray]
    escape: list[np.ndarray]


def normal(text: str) -> bytes:
    return text.lower().encode()


def train(texts: dict[str, list[str]], order: int = 3) -> ContextModel:
    """Trees from sample texts by language; every context seen is kept."""
    languages = sorted(texts)
    streams = {lang: np.frombuffer(b"\n".join([b"", *map(normal, texts[lang]), b""]), "u1") for lang in languages}
    seen = np.zeros(256, bool)
    for stream in streams.values():
        seen[np.unique(stream)] = True
    symbol = np.zeros(256, "i8")
    symbol[seen] = np.arange(1, seen.sum() + 1)
    width = int(seen.sum()) + 1
    model = ContextModel(languages, order, symbol.astype("i4"), width, [], [], [], [])
    lower_grams, lower = np.zeros(1, "i8"), np.full((1, len(languages)), 1 / 256)
    for k in range(order + 1):
        counts = [np.unique(_codes(symbol[streams[lang]], k, width), return_counts=True) for lang in languages]
        grams = np.unique(np.concatenate([g for g, _ in counts]))
        contexts, of = np.unique(grams // width, return_inverse=True)
        # what the next shorter context gives: its gram was seen wherever this one was
        p = lower[np.searchsorted(lower_grams, grams % width**k)] if k else np.repeat(lower, len(grams), 0)
        escape = np.zeros((len(contexts), len(languages)))
        for j, (gram, n) in enumerate(counts):
            at = np.searchsorted(grams, gram)
            total, distinct = np.bincount(of[at], n, len(contexts)), np.bincount(of[at], minlength=len(contexts))
            known = distinct > 0
            leave = np.where(known, distinct / np.maximum(1, total + distinct), 1.0)
            p[:, j] *= leave[of]
            p[at, j] = n / (total + distinct)[of[at]]
            escape[:, j] = -np.log2(leave)
        slot = np.full(width**k, -1, "i4")
        slot[contexts] = np.arange(len(contexts))
        entry = np.full((len(contexts), width), -1, "i4")
        entry[of, grams % width] = np.arange(len(grams))
        model.slot.append(slot)
        model.entry.append(entry)
        model.bits.append(-np.log2(p))
        model.escape.append(escape)
        lower_grams, lower = grams, p
    return model


def _codes(stream: np.ndarray, k: int, width: int) -> np.ndarray:
    """Every k + 1 symbols in a row as one number."""
    code = np.zeros(max(0, len(stream) - k), "i8")
    for j in range(k + 1):
        code = code * width + stream[j : len(stream) - k + j]
    return code


def code_lengths(model: ContextModel, texts: list[bytes], block: int = 1 << 19) -> np.ndarray:
    """Bits of every text (rows) in every language (columns)."""
    many = len(model.languages)
    out = np.zeros((len(texts), many))
    sizes = np.array([len(t) for t in texts], "i8")
    stream = np.concatenate([np.zeros(model.order, "i4"), model.symbol[np.frombuffer(b"".join(texts), "u1")]])
    doc_of, begin = np.repeat(np.arange(len(texts), dtype="i4"), sizes), np.cumsum(sizes) - sizes
    for a in range(0, len(doc_of), block):
        doc = doc_of[a : a + block]
        first, n = int(doc[0]), len(doc)
        doc = doc - first
        docs = int(doc[-1]) + 1
        place = np.arange(a, a + n) - begin[first : first + docs][doc]
        back = [stream[a + model.order - j : a + model.order - j + n] for j in range(model.order + 1)]
        contexts = [np.zeros(n, "i4")]
        for k in range(1, model.order + 1):  # the byte k places before is the context's first
            contexts.append(back[k] * model.width ** (k - 1) + contexts[-1])

        def add(at, rows):
            for j in range(many):
                out[first : first + docs, j] += np.bincount(doc[at], rows[:, j], docs)

        left = np.arange(n)
        for k in range(model.order, -1, -1):
            at = left if k == 0 else left[place[left] >= k]
            number = model.slot[k][contexts[k][at]]
            at, number = at[number >= 0], number[number >= 0]
            row = model.entry[k][number, back[0][at]]
            hit = row >= 0
            add(at[hit], model.bits[k][row[hit]])
            add(at[~hit], model.escape[k][number[~hit]])
            rest = np.zeros(n, bool)
            rest[left] = True
            rest[at[hit]] = False
            left = np.flatnonzero(rest)
        out[first : first + docs] += 8.0 * np.bincount(doc[left], minlength=docs)[:, None]
    return out


def sample_texts(labelled: DataFrame, per_language: int = 400, seed: int = 17) -> dict[str, list[str]]:
    """About per_language whole texts of every language (`drawn`); the bound holds at every size."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    out: dict[str, list[str]] = {}
    for r in drawn(labelled, share, seed, by=("lang",)).select("lang", "text").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return {lang: sorted(rows) for lang, rows in out.items()}


def usual_bits(texts: dict[str, list[str]], least: int = 64) -> float:
    """The most bits a byte that a text of each second half of the sample (of `least` bytes or more) needs under the trees of the first halves."""
    model = train({lang: rows[::2] for lang, rows in texts.items()})
    rest = [x for x in map(normal, (t for rows in texts.values() for t in rows[1::2])) if len(x) >= least]
    return float((code_lengths(model, rest).min(1) / [len(x) for x in rest]).max()) if rest else 8.0


def identify(docs: DataFrame, model: ContextModel | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, lang_pred, score (share of the best language's probability) and bits_per_byte (what the text costs in the best language).

    A text that is null, empty or without letters is `und` with score 0 and no bits, and so is every
    text if there is no model (nothing to learn from).  Languages that tie: the one first
    in alphabetical order.  Whole texts are read, whatever their length; rows are
    independent; other columns are not read.
    """
    kept = [f for f in docs.schema.fields if f.name in keep and f.name not in ("lang_pred", "score", "bits_per_byte")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string, score double, bits_per_byte double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in arrow_slices(batches, "_text", 4 << 20):
            texts = texts_of(b.column("_text"))
            lettered = np.array([bool(m) and bool(LETTER.search(t)) for t in texts], bool)
            lang = np.full(len(texts), "und", object)
            score, rate = np.zeros(len(texts)), np.zeros(len(texts))
            if lettered.any():
                read = [normal(t) if x else b"" for t, x in zip(texts, lettered)]
                cost = code_lengths(m, read)
                best = cost.argmin(1)
                share = 1 / np.exp2(np.minimum(0, cost.min(1)[:, None] - cost)).sum(1)
                lang[lettered] = np.array(m.languages, object)[best][lettered]
                score[lettered] = share[lettered]
                rate = cost.min(1) / np.maximum(1, [len(t) for t in read])
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(lang, pa.string()), pa.array(score), pa.array(rate, mask=~lettered)], names=[*(f.name for f in kept), "lang_pred", "score", "bits_per_byte"])

    return docs.select(*(f.name for f in kept), F.col("text").alias("_text")).mapInArrow(tidied(run), schema)


def lettered(docs: DataFrame) -> DataFrame:
    """Rows to learn from: with a language and a text that has letters."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))


def train_on(docs: DataFrame, per_language: int = 400) -> ContextModel | None:
    """A model from rows with a language and a text; None if there are none.  Null and repeated rows need no care."""
    texts = sample_texts(lettered(docs), per_language)
    return train(texts) if texts else None


def predict_languages(docs: DataFrame, per_language: int = 400, folds: int = 4, held: int = 2) -> DataFrame:
    """Learn from documents outside the held-out fold, predict for all: doc_id, held_out, lang_pred, score, bits_per_byte.

    The fold is crc32 of doc_id as text, modulo `folds`; a null doc_id is never held out.
    Rows are as `identify` has them: each is predicted on its own, so repeated rows come
    back as often; null, empty and unlettered texts are `und`; other columns are not read;
    an empty table gives no rows.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, F.lit(False))
    marked = docs.select("doc_id", "text", "lang", fold.alias("held_out"))
    return identify(marked, train_on(marked.where(~F.col("held_out")), per_language), ("doc_id", "held_out"))
