"""Language-model scoring: a causal self-attention model over subword ids, and a word-count base.

A text is its words, A-Z as lower case, and an end.  Each word is encoded, with a space
before it, into subword ids of a public vocabulary; the end is an id of its own.  The
model predicts an id in two steps, p(class | ids before) * p(id | class).  Classes are
clusters of ids by their neighbours, apart for ids that begin a word.  The first factor
is one layer of causal self-attention in numpy.  Counts of adjacent ids over all texts of
the training fold, also across words, give the classes and the table from the latest id;
attention is trained beside them on all texts of the fold: some train it on the driver
first, from there each task takes its texts in steps of its own, and the tasks' weights
are averaged.  All texts are encoded once and their ids kept, from which words are counted too.
The second factor is the id's share of its class over the whole fold, which within a word
is mixed with its share of the class after the id before it (for the `pairs` most frequent
ids; Witten-Bell weights).  Texts are scored in windows that overlap: each id is scored once, with at
least `context` ids before it, in batches of windows under one mask.
"""

from __future__ import annotations

import math
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.bpe import loaded
from inkloom.llm.common import arrow_slices, cut, drawn, tidied
from inkloom.llm.library import SpacedWords, strings, words_in

LOG10 = math.log(10)
#: Least sum that a step divides by, as one task's weights that are no numbers would reach all.
TINY = np.float32(1e-30)


@dataclass
class Shape:
    context: int = 8
    scored: int = 24
    size: int = 16

    @property
    def window(self) -> int:
        return self.context + self.scored


class CausalModel:
    """One head of causal attention over learned id and place vectors, and a table from the latest id to class scores."""

    def __init__(self, classes: np.ndarray, count: int, shape: Shape, seed: int = 7):
        rng = np.random.default_rng(seed)
        ids, d = len(classes), shape.size
        self.classes, self.count, self.shape = classes.astype("i4"), count, shape
        normal = lambda *s, by: (rng.normal(size=s) * by).astype("f4")
        self.w = {"id": normal(ids, d, by=0.3), "place": normal(shape.window, d, by=0.3), "latest": np.zeros((ids, count), "f4")}
        for name in ("query", "key", "value"):
            self.w[name] = normal(d, d, by=d**-0.5)
        self.w["out"] = normal(d, count, by=0.1)
        self.w["bias"] = np.zeros(count, "f4")
        i, j = np.arange(shape.scored)[:, None], np.arange(shape.window)
        self.mask = np.where(j <= i + shape.context, 0, -1e9).astype("f4")
        self.tables = self.steps = self.room = None

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """What leads from a vector to what meets other vectors, and from mixed vectors, with a one after each, to class scores: products of two weights each."""
        w = self.w
        return w["query"] @ w["key"].T / np.float32(math.sqrt(self.shape.size)), np.concatenate([w["value"] @ w["out"], w["bias"][None]])

    def prepare(self) -> CausalModel:
        """Tables by id and by place of what meets others, of the vectors and of ones, and what leads to class scores."""
        d = self.shape.size
        meet, out = self.joined()
        wide = np.concatenate([meet, np.eye(d), np.zeros((d, 1))], 1).astype("f4")
        place = self.w["place"] @ wide
        place[:, -1] = 1  # the weights' sum comes with what they mix
        self.tables = (self.w["id"] @ wide, place, out)
        self.ones = np.ones(self.count, "f4")
        return self

    def class_logs(self, inputs: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of the target classes (windows x scored); inputs: windows x window."""
        d, c = self.shape.size, self.shape.context
        x = self.tables[0].take(inputs, 0, mode="clip")
        x += self.tables[1]
        a = np.matmul(x[:, c:, :d], x[:, :, d : 2 * d].transpose(0, 2, 1))
        a += self.mask
        if a.max() > 60:
            np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        mixed = np.matmul(a, x[:, :, d:])
        mixed *= 1 / mixed[:, :, d:]  # whose last column becomes one, for the bias
        z = mixed.reshape(-1, d + 1) @ self.tables[2]
        z += self.w["latest"].take(inputs[:, c:].ravel(), 0, mode="clip")
        picked = z[np.arange(len(z)), target.ravel()]
        np.exp(z, out=z)
        return (picked - np.log(z @ self.ones)).reshape(target.shape)

    def step(self, inputs: np.ndarray, target: np.ndarray, live: np.ndarray, most: int = 32) -> tuple[float, dict]:
        """Loss and gradients of a batch, but for the table from the latest id; live marks the cells that count.

        `most` windows are worked on at a time, in arrays that are used again, as these fit a processor's cache.
        """
        d, w, root = self.shape.size, self.w, np.float32(math.sqrt(self.shape.size))
        meet, out = self.joined()
        share = (live / max(1, int(live.sum()))).astype("f4")
        dx = np.empty((*inputs.shape, d), "f4")
        loss, g_meet, g_out, g_place = 0.0, np.zeros_like(meet), np.zeros_like(out), np.zeros_like(w["place"])
        for k in range(0, len(inputs), most):
            part = slice(k, k + most)
            loss += self._block(inputs[part], target[part].ravel(), share[part].ravel(), meet, out, dx[part], g_meet, g_out)
            g_place += dx[part].sum(0)
        g = {"out": w["value"].T @ g_out[:d], "bias": g_out[d], "query": g_meet @ w["key"] / root, "key": g_meet.T @ w["query"] / root, "value": g_out[:d] @ w["out"].T, "place": g_place}
        g["id"] = (inputs.ravel(), dx.reshape(-1, d))
        return loss, g

    def _room(self, windows: int) -> list[np.ndarray]:
        """Arrays for the values and gradients of so many windows, given anew when there are more of these than before."""
        if self.room is None or len(self.room[0]) < windows:
            shape, cells = self.shape, self.shape.scored * windows
            x, a, mixed = (windows, shape.window, shape.size), (windows, shape.scored, shape.window), (windows, shape.scored, shape.size)
            self.room = [np.zeros(s, "f4") for s in (x, x, x, x, a, a, mixed, mixed)] + [np.ones((cells, shape.size + 1), "f4"), *[np.empty((cells, self.count), "f4") for _ in range(2)]]
        cells = self.shape.scored * windows
        return [r[:windows] for r in self.room[:8]] + [r[:cells] for r in self.room[8:]]

    def _block(self, inputs, target, share, meet, out, dx, g_meet, g_out) -> float:
        """The loss of some windows; dx becomes the gradients of their vectors, those of meet and out (`joined`) are added to theirs."""
        d, c, w = self.shape.size, self.shape.context, self.w
        x, y, dy, back, a, ds, mixed, dm, with_one, z, more = self._room(len(inputs))
        np.take(w["id"], inputs, 0, out=x, mode="clip")
        x += w["place"]
        wide, q = x.reshape(-1, d), y[:, c:]
        np.matmul(wide, meet, out=y.reshape(-1, d))
        np.matmul(q, x.transpose(0, 2, 1), out=a)
        a += self.mask
        if a.max() > 60:
            np.minimum(a, 60, out=a)
        np.exp(a, out=a)
        less = 1 / np.maximum(a.reshape(-1, a.shape[2]) @ np.ones(a.shape[2], "f4"), TINY).reshape(*a.shape[:2], 1)  # the weights' sum divides what they mix, here and on the way back
        np.matmul(a, x, out=mixed)
        mixed *= less
        with_one[:, :d] = mixed.reshape(-1, d)
        np.take(w["latest"], inputs[:, c:].ravel(), 0, out=z, mode="clip")
        z += np.matmul(with_one, out, out=more)
        if z.max() > 60:
            z -= z.max(1, keepdims=True)
        cells = np.arange(len(z))
        picked = z[cells, target]
        np.exp(z, out=z)
        total = np.maximum(z @ np.ones(self.count, "f4"), TINY)
        loss = float(((np.log(total) - picked) * share).sum())
        z[cells, target] -= total  # share / total times this is the gradient of the scores
        share = share / total
        np.matmul(z, out[:d].T, out=dm.reshape(-1, d))
        dm *= less * share.reshape(less.shape)
        with_one *= share[:, None]
        g_out += with_one.T @ z
        with_one[:, d] = 1
        np.matmul(dm, x.transpose(0, 2, 1), out=ds)
        ds -= np.einsum("btd,btd->bt", dm, mixed)[:, :, None]
        ds *= a
        np.matmul(ds.transpose(0, 2, 1), q, out=dx)
        dx += np.matmul(a.transpose(0, 2, 1), dm, out=back)
        np.matmul(ds, x, out=dy[:, c:])
        flat = dy.reshape(-1, d)
        g_meet += wide.T @ flat
        dx += np.matmul(flat, meet.T, out=back.reshape(-1, d)).reshape(dx.shape)
        return loss

    def fit(self, documents: list[np.ndarray], begin: int, epochs: int = 3, batch: int = 96, rate: float = 0.01, seed: int = 9, pairs: np.ndarray | None = None) -> list[float]:
        """pairs: how often each class follows each id (ids x classes), else counted in the documents."""
        inputs, target, live = windows(documents, self.shape, begin)
        target = self.classes[target]
        # the table is how often a class follows an id
        if pairs is None:
            pairs = np.zeros_like(self.w["latest"])
            np.add.at(pairs, (inputs[:, self.shape.context :][live], target[live]), 1)
        after = pairs.sum(0, dtype="f8")
        prior = (after + 1) / (after.sum() + self.count)
        for k in range(0, len(pairs), 4096):
            part = pairs[k : k + 4096]
            self.w["latest"][k : k + 4096] = np.log((part + 4 * prior) / (part.sum(1, dtype="f8", keepdims=True) + 4)) - np.log(prior)
        self.w["bias"] = np.log(prior).astype("f4")
        rng = np.random.default_rng(seed)
        self.steps = Steps(self.w)
        losses = []
        for epoch in range(epochs):
            total, order = 0.0, rng.permutation(len(inputs))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                loss, g = self.step(inputs[rows], target[rows], live[rows])
                total += loss * len(rows)
                self.steps.take(self.w, g, rate * (1 - 0.8 * (self.steps.taken + 1) / (epochs * (len(order) / batch + 1))))
            losses.append(total / max(1, len(order)))
        return losses


class Steps:
    """What steps of a model's weights go by: of the id vectors the squared gradients summed, of the others two running means.  The table from the latest id stays."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.second = {k: np.zeros_like(v) for k, v in w.items() if k != "latest"}
        self.first = {k: np.zeros_like(v) for k, v in w.items() if k not in ("id", "latest")}
        self.taken = 0

    def copy(self) -> Steps:
        out = Steps({})
        out.second, out.first, out.taken = {k: v.copy() for k, v in self.second.items()}, {k: v.copy() for k, v in self.first.items()}, self.taken
        return out

    def take(self, w: dict[str, np.ndarray], g: dict, pace: float):
        self.taken += 1
        first, second = self.first, self.second
        dense = []
        for name, grad in g.items():
            if not isinstance(grad, tuple):
                dense.append(name)
                continue
            # rows of a table
            ids, rows = grad
            few = ids.astype("u2") if len(w[name]) <= 1 << 16 else ids  # short numbers are sorted by their digits
            sort = np.argsort(few, kind="stable")
            ids = ids.take(sort)
            starts = np.append(0, np.flatnonzero(ids[1:] != ids[:-1]) + 1)
            ids, rows = ids.take(starts), rows.take(sort, 0)
            two_by_two = rows.view("c8") if rows.shape[1] % 2 == 0 else rows  # sums of complex numbers are those of their parts, in half the additions
            part = np.add.reduceat(two_by_two, starts, axis=0).view("f4")
            sums = second[name].take(ids, 0)
            sums += part * part
            second[name][ids] = sums
            part *= np.float32(3 * pace)
            part /= np.sqrt(sums) + np.float32(1e-6)
            w[name][ids] = w[name].take(ids, 0) - part
        # the others side by side
        grad, one, two = (np.concatenate([x[k].ravel() for k in dense]) for x in (g, first, second))
        one = np.float32(0.9) * one + np.float32(0.1) * grad
        two = np.float32(0.98) * two + np.float32(0.02) * grad * grad
        less = (pace * one / (1 - 0.9**self.taken) / (np.sqrt(two / (1 - 0.98**self.taken)) + 1e-8)).astype("f4")
        at = 0
        for name in dense:
            to = at + w[name].size
            first[name], second[name] = one[at:to].reshape(w[name].shape), two[at:to].reshape(w[name].shape)
            w[name] -= less[at:to].reshape(w[name].shape)
            at = to


@dataclass
class Layout:
    """Windows over documents: every id is a target in exactly one of them.

    A document begins with `context` ids `begin`, and its k-th window scores ids
    k * scored to (k + 1) * scored.  The documents stand in one stream, each after its beginning.
    """

    shape: Shape
    begin: int
    stream: np.ndarray
    base: np.ndarray  # where a document's beginning stands, by window
    start: np.ndarray
    size: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def part(self, a: int = 0, b: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, targets and live cells of windows a to b."""
        shape, start = self.shape, self.start[a:b]
        first = self.base[a:b] + start
        # inputs are the ids before each place from start - context on; targets start .. start + scored
        inputs = self.stream[np.maximum(0, first[:, None] - 1 + np.arange(shape.window))]
        inputs[start == 0, 0] = self.begin
        target = self.stream[first[:, None] + shape.context + np.arange(shape.scored)]
        live = start[:, None] + np.arange(shape.scored) < self.size[a:b][:, None]
        return inputs, target, live


def layout(documents: list[np.ndarray], shape: Shape, begin: int) -> Layout:
    sizes = np.array([len(x) for x in documents], "i8")
    doc = owners(documents, shape)
    count = -(-sizes // shape.scored)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * shape.scored
    pad = shape.context
    base = np.cumsum(sizes + pad) - sizes - pad
    stream = np.full(int((sizes + pad).sum()) + shape.window + 1, begin, "i4")
    for at, x in zip(base.tolist(), documents):
        stream[at + pad : at + pad + len(x)] = x
    return Layout(shape, begin, stream, base[doc], start, sizes[doc])


def windows(documents: list[np.ndarray], shape: Shape, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and live cells of all windows."""
    return layout(documents, shape, begin).part()


def owners(documents: list[np.ndarray], shape: Shape) -> np.ndarray:
    return np.repeat(np.arange(len(documents)), [-(-len(x) // shape.scored) for x in documents])


def common_ids(freq: np.ndarray, known: int = 4000) -> np.ndarray:
    return np.argsort(-freq, kind="stable")[: min(known, int((freq >= 5).sum()))]


#: So many of the common ids are looked for beside an id.
BESIDE = 400


def cluster(freq: np.ndarray, one: np.ndarray, two: np.ndarray, n: np.ndarray, count: int = 48, seed: int = 13) -> np.ndarray:
    """A class for every id: k-means over what stands beside it (ids `one` before ids `two`, n times); ids too rare for that share the last class."""
    ids, common = len(freq), common_ids(freq)
    out = np.full(ids, count - 1, "i4")
    if len(common) <= count:
        out[common] = np.arange(len(common)) % count
        return out
    column = np.full(ids, -1, "i8")
    beside = min(BESIDE, len(common))
    column[common[:beside]] = np.arange(beside)
    row = np.full(ids, -1, "i8")
    row[common] = np.arange(len(common))
    table = np.zeros((len(common), 2 * beside))
    for x, y, shift in ((one, two, 0), (two, one, beside)):
        fine = (row[x] >= 0) & (column[y] >= 0)
        np.add.at(table, (row[x[fine]], column[y[fine]] + shift), n[fine])
    shares = np.sqrt(table / np.maximum(1, table.sum(1, keepdims=True)))
    u, s, _ = np.linalg.svd(shares.T @ shares)
    x = shares @ u[:, :24]
    rng = np.random.default_rng(seed)
    weight = freq[common].astype("f8")
    centre = x[rng.choice(len(x), count - 1, replace=False, p=weight / weight.sum())]
    for _ in range(15):
        near = ((centre * centre).sum(1) - 2 * x @ centre.T).argmin(1)
        for j in range(count - 1):
            if (near == j).any():
                centre[j] = np.average(x[near == j], axis=0, weights=weight[near == j])
    out[common] = near
    return out


def split(classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes cut in two by whether an id begins a word, numbered anew."""
    return np.unique(classes * 2 + first, return_inverse=True)[1].astype("i4")


class Within:
    """Natural log of p(id | class, id before)."""

    def __init__(self, classes: np.ndarray, counts: np.ndarray, first: np.ndarray, rank: np.ndarray, follows: np.ndarray):
        """counts: of ids; first: ids that begin a word; rank: place of the frequent ids, others len(follows); follows: counts of pairs of these within words."""
        m, c = len(follows), int(classes.max()) + 1
        self.classes, self.rank, self.first = classes, rank.astype("i4"), first
        counts = counts + 0.1
        share = counts / np.bincount(classes, counts, c)[classes]
        self.share = np.log(share).astype("f4")
        at = np.zeros(m, "i8")
        at[rank[rank < m]] = np.flatnonzero(rank < m)
        self.after, self.rest = np.zeros((m + 1, m + 1), "f4"), np.zeros((m + 1, c), "f4")
        for k in range(0, m, 256):  # by blocks, as m x m of doubles several times over is much for a driver
            f = follows[k : k + 256]
            total, kinds = np.zeros((len(f), c)), np.zeros((len(f), c))
            np.add.at(total.T, classes[at], f.T)
            np.add.at(kinds.T, classes[at], (f > 0).T)
            rest = np.where(total > 0, kinds / np.maximum(1, total + kinds), 1.0)
            seen = f / np.maximum(1, total[:, classes[at]])
            self.after[k : k + len(f), :m] = np.log((1 - rest[:, classes[at]]) * seen + rest[:, classes[at]] * share[at])
            self.rest[k : k + len(f)] = np.log(rest)
        self.after[m, :m] = self.share[at]

    def logs(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        m = len(self.after) - 1
        r2 = self.rank[ids]
        r1 = np.where(self.first[ids], m, self.rank[before])
        out = self.after[r1, r2]
        odd = r2 == m
        if odd.any():
            out[odd] = self.share[ids[odd]] + self.rest[r1[odd], self.classes[ids[odd]]]
        return out


@dataclass
class Scorer:
    model: CausalModel
    within: Within
    end: int

    def scores(self, documents: list[np.ndarray], most: int = 128) -> np.ndarray:
        """log10 probability of every document's ids."""
        out = np.zeros(len(documents))
        shape = self.model.shape
        placed = layout(documents, shape, self.end)
        doc = owners(documents, shape)
        for at in range(0, len(placed), most):
            x, t, m = placed.part(at, at + most)
            logs = self.model.class_logs(x, self.model.classes[t]) + self.within.logs(x[:, shape.context :], t)
            np.add.at(out, doc[at : at + most], np.where(m, logs, 0).sum(1, dtype="f8"))
        return out / LOG10


def fold_of(key: str, folds: int, held: int):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == held, F.lit(False))


class Sums:
    """Counts by key within a task, given out when there are many; the other key's column is null."""

    def __init__(self, name: str, most: int = 1_500_000):
        self.name, self.most, self.held, self.rows = name, most, [], 0

    def add(self, keys: pa.Array, n: pa.Array):
        self.held.append(pa.table({"key": keys, "n": n}))
        self.rows += len(keys)
        if self.rows > self.most:
            self.held = [self._merged()]
            self.rows = self.held[0].num_rows
            if 2 * self.rows > self.most:
                yield from self.out()

    def _merged(self) -> pa.Table:
        out = pa.concat_tables(self.held).group_by("key").aggregate([("n", "sum")])
        return pa.table({"key": out.column("key"), "n": out.column("n_sum")})

    def out(self):
        if self.held:
            merged = self._merged()
            none = {"word": pa.binary(), "pair": pa.int64()}
            columns = [merged.column("key") if c == self.name else pa.nulls(merged.num_rows, kind) for c, kind in none.items()]
            yield from pa.table([*columns, merged.column("n")], names=[*none, "n"]).to_batches(50_000)
        self.held, self.rows = [], 0


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs with the ids of each text and its end (`ids` binary, little-endian numbers of `width` bytes) in place of the text."""
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        words = loaded(SpacedWords, vocabulary)
        wide = width(words.size)
        for b in arrow_slices(batches, "text", 4 << 20):
            found, at, count = words_in(b.column("text"))
            stream, sizes = words.stream(strings(found), at, count)
            ends = np.concatenate([[0], np.cumsum(sizes)]) * wide
            ids = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(ends.astype("i8")), pa.py_buffer(stream.astype(f"<u{wide}"))])
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], ids.cast(pa.binary())], names=[*[f.name for f in kept], "ids"])

    return docs.mapInArrow(tidied(run), ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in kept], "ids binary"]))


def width(size: int) -> int:
    """Bytes of an id."""
    return 2 if size <= 1 << 16 else 4


def streams(batches, size: int):
    """Batches (a few MB of ids each), the ids of all their texts in turn, and how many each text has."""
    wide = width(size)
    for b in arrow_slices(batches, "ids", wide * 3 << 19):
        ids = b.column("ids").cast(pa.large_binary())
        at = np.frombuffer(ids.buffers()[1], "i8")[ids.offset : ids.offset + len(ids) + 1]
        yield b, np.frombuffer(ids.buffers()[2], f"<u{wide}", (at[-1] - at[0]) // wide, at[0]).astype("i4"), np.diff(at) // wide


def spelled(stream: np.ndarray, words: SpacedWords) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of texts' ids, each as its ids' bytes and the end as one of them; the place among them of each word in turn; and where in the stream each begins.

    Ids that begin a word stand nowhere else, and a byte-level vocabulary spells each word in its own way.
    """
    wide, starts = width(words.size), np.flatnonzero(words.begins[stream])
    ends = np.append(starts, len(stream)) * wide
    runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype("i8")), pa.py_buffer(stream.astype(f"<u{wide}"))])
    runs = runs.dictionary_encode()
    return runs.dictionary.cast(pa.binary()), runs.indices.to_numpy(), starts


def counted(docs: DataFrame, vocabulary: str, ids: DataFrame | None = None) -> DataFrame:
    """(word binary, pair bigint, n bigint): how often a word (its ids' bytes, `spelled`) or the end stands in all texts of docs (pair null), and how often an id follows another, an end standing before each text (word null).

    pair is before * ids + id.  Summed within a batch, within a task, and then by key.
    ids: the texts of docs `encoded`, if at hand.
    """

    def count(batches):
        words, by_word, by_pair = loaded(SpacedWords, vocabulary), Sums("word"), Sums("pair")
        kind = "u4" if words.size <= 1 << 16 else "i8"
        for _, stream, _ in streams(batches, words.size):
            found, at, _ = spelled(stream, words)
            yield from by_word.add(found, pa.array(np.bincount(at, minlength=len(found)), pa.int64()))
            before = np.concatenate([[words.end], stream[:-1]]).astype(kind)
            pairs, n = np.unique(before * np.array(words.size, kind) + stream.astype(kind), return_counts=True)
            yield from by_pair.add(pa.array(pairs.astype("i8")), pa.array(n, pa.int64()))
        yield from by_word.out()
        yield from by_pair.out()

    ids = encoded(docs.select("text"), vocabulary) if ids is None else ids.select("ids")
    return ids.mapInArrow(tidied(count), "word binary, pair bigint, n bigint").groupBy("word", "pair").agg(F.sum("n").alias("n"))


def frequent(words: DataFrame, most: int) -> tuple[dict[bytes, float], int, int]:
    """log10(n + 1) of the words more frequent than some count, chosen so that they are `most` at most, of which only these reach the driver; how often all words stand; and how many there are."""
    level = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r["level"], r["k"], r["n"]) for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("k"), F.sum("n").alias("n")).collect()), reverse=True)
    n, v = sum(x for _, _, x in sizes), sum(k for _, k, _ in sizes)
    least, held = None, 0
    for at, k, _ in sizes:
        if held + k > most:
            break
        least, held = at, held + k
    if least is None:
        return {}, n, v
    got = words.where(level >= least).toArrow()
    return dict(zip(got.column("word").to_pylist(), np.log10(got.column("n").to_numpy() + 1.0).tolist())), n, v


def picked(pairs: DataFrame, choose) -> tuple[np.ndarray, np.ndarray]:
    """What choose(pair, n) makes of the rows: keys, and how often each occurs, summed."""

    def run(batches):
        for b in batches:
            key, n = choose(b.column("pair").to_numpy(), b.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    got = pairs.mapInArrow(tidied(run), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return got.column("key").to_numpy(), got.column("n").to_numpy()


def texts_to_train(documents: int, least: int) -> int:
    """How many texts train the attention on the driver first: at least `least`, and with the square root of the documents more."""
    return max(least, math.ceil(2 * math.sqrt(documents)))


#: Changes of weights are summed as whole numbers of this part of one, so that their order does not matter.
PART = 1 << 20


def taught(model: CausalModel, ids: DataFrame, begin: int, pace: float = 0.005, batch: int = 96, most: int = 1 << 17, seed: int = 10) -> CausalModel:
    """The model after all texts of ids (`encoded`), each taken once.

    Each task goes from the given weights through its texts in steps, of windows drawn
    from among `most` at a time.  An id's vector becomes the mean of the tasks' vectors by
    how often they met the id, another weight the mean by their ids.  A task gives at most
    one row for each id of the vocabulary and for every `size` other weights; sums of
    these are what reaches the driver.
    """
    size, d = len(model.classes), model.shape.size
    dense = [k for k in model.w if k not in ("id", "latest")]
    shared = ids.sparkSession.sparkContext.broadcast(model)

    def flat(w):
        x = np.concatenate([w[k].ravel() for k in dense])
        return np.append(x, np.zeros(-len(x) % d, "f4")).reshape(-1, d)

    def run(batches):
        given = shared.value
        mine, steps, rng, met = copy(given), given.steps.copy(), np.random.default_rng(seed), np.zeros(size, "i8")
        mine.w = {k: v if k == "latest" else v.copy() for k, v in given.w.items()}
        for _, stream, sizes in streams(batches, size):
            met += np.bincount(stream, minlength=size)
            placed = layout(np.split(stream, np.cumsum(sizes)[:-1]), mine.shape, begin)
            for a in range(0, len(placed), most):
                inputs, target, live = placed.part(a, a + most)
                target = mine.classes[target]
                order = rng.permutation(len(inputs))
                for at in range(0, len(order), batch):
                    rows = order[at : at + batch]
                    steps.take(mine.w, mine.step(inputs[rows], target[rows], live[rows])[1], pace)
        at, rest = np.flatnonzero(met), flat(mine.w) - flat(given.w)
        if len(at):
            n = np.concatenate([met[at], np.full(len(rest), met.sum())])
            change = np.rint(np.concatenate([mine.w["id"][at] - given.w["id"][at], rest]).astype("f8") * n[:, None] * PART).astype("i8")
            key = np.concatenate([at, size + np.arange(len(rest))])
            yield from pa.table([key, n, *change.T], names=["key", "n", *[f"w{j}" for j in range(d)]]).to_batches(10_000)

    names = ["n", *[f"w{j}" for j in range(d)]]
    changes = ids.select("ids").mapInArrow(tidied(run), ", ".join(f"{c} bigint" for c in ["key", *names]))
    got = changes.groupBy("key").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    shared.destroy()
    if not got.num_rows:
        return model
    key, n, *sums = (got.column(c).to_numpy() for c in ["key", *names])
    change = (np.stack(sums, 1) / n[:, None] / PART).astype("f4")
    model.w["id"][key[key < size]] += change[key < size]
    rest = flat(model.w)
    rest[key[key >= size] - size] += change[key >= size]
    at, rest = 0, rest.ravel()
    for k in dense:
        model.w[k] = rest[at : at + model.w[k].size].reshape(model.w[k].shape)
        at += model.w[k].size
    return model


def train(training: DataFrame, table: DataFrame, documents: int, vocabulary: str, sample: int = 400, classes: int = 56, pairs: int = 2048, shape: Shape | None = None, ids: DataFrame | None = None) -> Scorer:
    """A model from all training documents: table (pair, n), the counts of adjacent ids in them, and ids, their texts `encoded` (encoded here if not given), of which `taught` learns attention.

    What reaches the driver is bounded by the vocabulary: an id's count, the pairs of
    `pairs` ids and of the common ids with those beside them, ids by classes, and changes
    of weights; and by the texts that attention sets out from (`texts_to_train` of them,
    `drawn`: distinct ones of a bounded length).
    Null texts are empty ones; without documents the model is untrained.
    """
    shape = shape or Shape()
    words = loaded(SpacedWords, vocabulary)
    size, end, first = words.size, words.end, words.begins
    counts = np.zeros(size, "i8")
    got = table.groupBy((F.col("pair") % size).alias("id")).agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("id").to_numpy()] = got.column("n").to_numpy()
    rank = np.full(size, pairs, "i4")
    rank[np.argsort(-counts, kind="stable")[:pairs]] = np.arange(pairs)
    common = common_ids(counts)
    known, beside = np.zeros(size, bool), np.zeros(size, bool)
    known[common], beside[common[:BESIDE]] = True, True

    def near(pair, n):
        one, two = pair // size, pair % size
        fine = (rank[one] < pairs) & (rank[two] < pairs) & ~first[two] | known[one] & beside[two] | beside[one] & known[two]
        return pair[fine], n[fine]

    pair, n = picked(table, near)
    one, two = pair // size, pair % size
    within_word = (rank[one] < pairs) & (rank[two] < pairs) & ~first[two]
    follows = np.zeros((pairs, pairs), "f4")
    follows[rank[one[within_word]], rank[two[within_word]]] = n[within_word]
    group = split(cluster(counts, one, two, n, classes), first)
    count = int(group.max()) + 1

    def by_class(pair, n):
        key, at = np.unique(pair // size * count + group[pair % size], return_inverse=True)
        return key, np.bincount(at, n, len(key)).astype("i8")

    key, n = picked(table, by_class)
    latest = np.zeros((size, count), "f4")
    latest.ravel()[key] = n
    rows = drawn(training, min(1.0, texts_to_train(documents, sample) / max(1, documents)), seed=31).select("text").collect()
    texts = pa.array(sorted(r["text"] or "" for r in rows), pa.string())
    found, at, many = words_in(texts)
    stream, sizes = words.stream(strings(found), at, many)
    first_texts = np.split(stream, np.cumsum(sizes)[:-1]) if len(sizes) else []
    within = Within(group, counts.astype("f8"), first, rank, follows)
    model = CausalModel(group, count, shape)
    if documents:
        model.fit(first_texts, end, pairs=latest)
        taught(model, encoded(training.select("text"), vocabulary) if ids is None else ids, end)
        model.steps = None
    return Scorer(model.prepare(), within, end)


def score_texts(docs: DataFrame, vocabulary: str, folds: int = 7, held: int = 2, sample: int = 400, common_words: int = 200_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text).

    Learnt from the documents outside the held-out fold (crc32 of doc_id as text, modulo
    `folds`; a null doc_id is never held out).  The `common_words` most frequent words
    are sent to all tasks; counts of all other words meet the texts' words in a join, in
    which each document has one row for each such word.

    A null text is an empty one, which has the end as its one token.  Rows that agree in
    doc_id and text are scored alike and all returned.  Other columns are not read.  If
    nothing can be learnt from, every base probability is 1 / (N + V + 1) = 1 and the
    model is untrained.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    marked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("held_out", fold_of("doc_id", folds, held))
    training = marked.where(~F.col("held_out"))
    documents = training.count()
    ids = cut(encoded(marked.withColumn("mark", F.xxhash64("text")), vocabulary))
    learnt = ids.where(~F.col("held_out"))
    table = cut(counted(training, vocabulary, learnt))
    words = table.where("word IS NOT NULL").select("word", "n")
    top, n, v = frequent(words, common_words)
    scorer = train(training, table.where("pair IS NOT NULL").select("pair", "n"), documents, vocabulary, sample, ids=learnt)
    shared, common = spark.sparkContext.broadcast(scorer), spark.sparkContext.broadcast(top)
    floor = math.log10(n + v + 1)

    def run(batches):
        known, lm, words = common.value.get, shared.value, loaded(SpacedWords, vocabulary)
        for b, stream, sizes in streams(batches, words.size):
            found, at, starts = spelled(stream, words)
            listed = strings(found)
            n_rows, text = b.num_rows, np.repeat(np.arange(b.num_rows), sizes)[starts]
            count = np.bincount(text, minlength=n_rows)
            value = np.fromiter((known(w, -1.0) for w in listed), "f8", len(listed))[at]
            rare = value < 0
            base = np.bincount(text, np.where(rare, 0, value), n_rows)
            found_here = count - np.bincount(text[rare], minlength=n_rows)
            scores = lm.scores(np.split(stream, np.cumsum(sizes)[:-1]))
            mark = b.column("mark")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), mark, b.column("held_out"), pa.array([b"\x00" + m.tobytes() for m in mark.to_numpy()], pa.binary()), pa.nulls(n_rows, pa.int64()), pa.array(count, pa.int64()), pa.array(found_here, pa.int64()), pa.array(base), pa.array(scores)],
                names=NAMES,
            )
            row, times = np.unique(text[rare] * max(1, len(listed)) + at[rare], return_counts=True)
            if len(row):
                of, word = pa.array(row // len(listed)), pa.array(row % len(listed))
                empty = lambda kind: pa.nulls(len(row), kind)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(of), mark.take(of), b.column("held_out").take(of), found.take(word), pa.array(times, pa.int64()), empty(pa.int64()), empty(pa.int64()), empty(pa.float64()), empty(pa.float64())],
                    names=NAMES,
                )

    # (a row's own key has an odd number of bytes, a word's an even one)
    parts = ids.mapInArrow(tidied(run), "doc_id bigint, mark bigint, held_out boolean, word binary, times bigint, n_tokens bigint, known bigint, base double, score double")
    matched = parts.join(words, "word", "left").withColumn("hit", F.col("times").isNotNull() & F.col("n").isNotNull())
    found = matched.groupBy("doc_id", "mark", "held_out").agg(
        F.count("n_tokens").alias("copies"),
        F.max("n_tokens").alias("n_tokens"),
        (F.sum("known") + F.coalesce(F.sum(F.when(F.col("hit"), F.col("times"))), F.lit(0))).alias("known"),
        (F.sum("base") + F.coalesce(F.sum(F.when(F.col("hit"), F.col("times") * F.log10(F.col("n") + 1))), F.lit(0.0))).alias("base"),
        F.max("score").alias("score"),
    )
    # rows that agree in doc_id and text were summed together: they share the sum and come back
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") / F.col("copies")).cast("bigint").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") / F.col("copies") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy"),
    ).drop("_copy")


NAMES = ["doc_id", "mark", "held_out", "word", "times", "n_tokens", "known", "base", "score"]
