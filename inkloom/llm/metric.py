"""Exact top-k search by inner product in M-trees.

An inner product becomes a distance: a vector v gets one more component,
sqrt(M^2 - |v|^2), M being the largest norm, and a query gets 0; then
|q - v|^2 = |q|^2 + M^2 - 2 <q, v>, so the nearest are those of the highest product.

A tree holds pages of entries.  An entry of an inner page has a routing object, a
covering radius and the distance to the page's own routing object; so has an entry of a
leaf page, with radius 0.  Queries search a tree together: pages come from a queue in the
order of their least possible distance to any query that may still need them, and entries
for which |d(q, parent) - d(entry, parent)| - radius is beyond the k-th best of all of
these are passed over without computing their distance.  Bounds are floating point and are
used with slack; the scores are exact integers.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import cut, tidied

#: Slack of the bounds over rounding errors, as a share of the lengths involved (a distance comes from a difference of squares).
SLACK = 1e-6


class MTree:
    """Pages are rows of arrays: entries first[p]..first[p+1] belong to page p; child[e] is a page, or -1 in a leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, capacity: int = 256):
        self.ids = ids
        self._place(vectors)
        self.pages: list[tuple] = []
        rng = np.random.default_rng(len(ids))
        self.root = self._build(np.arange(len(ids)), None, capacity, rng)[0] if len(ids) else None

    def _build(self, rows: np.ndarray, parent: np.ndarray | None, capacity: int, rng) -> tuple[int, float]:
        """A page over the rows; its number and the covering radius about parent."""
        far = self._from(parent, rows) if parent is not None else np.zeros(len(rows))
        if len(rows) <= capacity:
            points = self.points[rows]
            self.pages.append((rows, points, (points * points).sum(1), np.zeros(len(rows)), far, np.full(len(rows), -1)))
            return len(self.pages) - 1, float(far.max())
        count = min(capacity, max(2, math.ceil(len(rows) / capacity)))
        pivots = rows[rng.choice(len(rows), count, replace=False)]
        near = self._nearest(rows, pivots)
        for _ in range(2):  # routing objects move to the middle of their rows
            middles = np.stack([self.points[rows[near == j]].mean(0) if (near == j).any() else self.points[pivots[j]] for j in range(count)])
            near = self._nearest(rows, middles, given=True)
        parts = [rows[near == j] for j in range(count)]
        keep = [j for j in range(count) if len(parts[j])]
        if len(keep) == 1:  # all alike: cut by count
            parts = np.array_split(rows, count)
            middles = np.stack([self.points[p].mean(0) for p in parts])
            keep = list(range(count))
        children, radii = [], []
        for j in keep:
            page, radius = self._build(parts[j], middles[j], capacity, rng)
            children.append(page)
            radii.append(radius)
        centres = middles[keep]
        to_parent = np.sqrt(((centres - parent) ** 2).sum(1)) if parent is not None else np.zeros(len(keep))
        self.pages.append((np.full(len(keep), -1), centres, (centres * centres).sum(1), np.array(radii), to_parent, np.array(children)))
        return len(self.pages) - 1, float(far.max()) if parent is not None else 0.0

    def packed(self) -> bytes:
        """The tree as bytes: vectors, and pages without what follows from the vectors."""
        pages = [(rows, None if child[0] < 0 else points, None, radii, far, child) for rows, points, _, radii, far, child in self.pages]
        return pickle.dumps((self.ids, self.vectors.astype(_narrow(self.vectors)), self.root, pages), protocol=5)

    @classmethod
    def unpacked(cls, blob: bytes) -> MTree:
        tree = cls.__new__(cls)
        tree.ids, vectors, tree.root, pages = pickle.loads(blob)
        tree._place(vectors.astype("i8"))
        tree.pages = []
        for rows, points, _, radii, far, child in pages:
            points = tree.points[rows] if points is None else points
            tree.pages.append((rows, points, (points * points).sum(1), radii, far, child))
        return tree

    def _place(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        x = vectors.astype("f8")
        norms = (x * x).sum(1)
        self.most = float(norms.max()) if len(x) else 0.0
        self.points = np.concatenate([x, np.sqrt(np.maximum(0, self.most - norms))[:, None]], 1)

    def _from(self, point: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - point) ** 2).sum(1))

    def _nearest(self, rows: np.ndarray, pivots: np.ndarray, given: bool = False) -> np.ndarray:
        c = pivots if given else self.points[pivots]
        out = np.empty(len(rows), "i8")
        for at in range(0, len(rows), 4096):
            x = self.points[rows[at : at + 4096]]
            out[at : at + 4096] = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        return out

    def search(self, query: np.ndarray, query_id: int, k: int) -> tuple[list[tuple[int, int]], int]:
        """The k rows of highest (score, then smallest id) but the query's own, and how many distances it took."""
        best = Best(np.array([query_id]), query.astype("i8")[None], k)
        computed = self.search_all(best)
        return [(s, i) for _, i, s in zip(*(x.tolist() for x in best.found()))], computed

    def search_all(self, best: Best, most: int = 4096) -> int:
        """Take this tree's rows into best, `most` queries at a time; how many distances it took."""
        if self.root is None:
            return 0
        return sum(self._search(best, np.arange(at, min(at + most, len(best.ids)))) for at in range(0, len(best.ids), most))

    def _search(self, best: Best, part: np.ndarray) -> int:
        """Queries go down together, each only into the pages that its own bounds leave."""
        x = best.vectors[part].astype("f8")
        square = (x * x).sum(1)
        slack = SLACK * (math.sqrt(self.most) + np.sqrt(square) + 1)
        # a product's terms and sums are whole numbers of at most this size, which floats hold exactly up to 2^24 or 2^53
        largest = math.sqrt(self.most * float(square.max(initial=0)))
        kind = "f4" if largest < 2**24 - 1 else "f8" if largest < 2**52 else "i8"
        whole, vectors = best.vectors[part].astype(kind), self.vectors.astype(kind)
        reach = best.reach(part, square, self.most)
        queue = [(0.0, 0, self.root, np.arange(len(part)), np.zeros(len(part)), None)]
        computed, ties = 0, 0
        while queue:
            _, _, page, who, bound, from_parent = heapq.heappop(queue)
            far = reach[who] + slack[who]
            near = bound <= far
            rows, points, squares, radii, to_parent, children = self.pages[page]
            if from_parent is not None:
                up, down = from_parent + far, from_parent - far
                near &= ((to_parent - radii).min() <= up) & ((to_parent + radii).max() >= down)
            if not near.any():
                continue
            who, far = who[near], far[near]
            if from_parent is not None:
                use = (to_parent - radii <= up[near].max()) & (to_parent + radii >= down[near].min())
                if not use.any():
                    continue
                if not use.all():
                    rows, points, squares, radii, children = rows[use], points[use], squares[use], radii[use], children[use]
            computed += len(who) * len(points)
            if children[0] < 0:
                changed = best.add(part[who], whole[who] @ vectors[rows].T, self.ids[rows])
                reach[changed - part[0]] = best.reach(changed, square[changed - part[0]], self.most)
            else:
                d = np.sqrt(np.maximum(0, squares + square[who][:, None] - 2 * (x[who] @ points[:, :-1].T)))
                least = np.maximum(0, d - radii)
                fine = least <= far[:, None]
                for e in np.flatnonzero(fine.any(0)).tolist():
                    ties += 1
                    own = fine[:, e]
                    heapq.heappush(queue, (float(least[own, e].min()), ties, int(children[e]), who[own], least[own, e], d[own, e]))
        return computed


class Best:
    """The k best (score, then smallest id) of each of many queries so far; a query's own id is no candidate."""

    NONE = -(2**62)

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.score = np.full((len(ids), k), self.NONE, "i8")
        self.vec = np.zeros((len(ids), k), "i8")

    def reach(self, rows: np.ndarray, square: np.ndarray, most: float) -> np.ndarray:
        """The distance of the k-th best in a tree whose largest squared norm is `most`."""
        last = self.score[rows, -1]
        return np.where(last > self.NONE, np.sqrt(np.maximum(0, square + most - 2.0 * last)), math.inf)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Take in scores (rows x ids); the rows that changed."""
        asked, last = self.ids[rows], self.score[rows, -1]
        for c in np.flatnonzero(np.isin(ids, asked)).tolist():
            scores[asked == ids[c], c] = self.NONE
        some = np.flatnonzero(scores.max(1) >= last)
        rows, scores, last = rows[some], scores[some], last[some]
        if len(ids) > self.k:  # what is below a page's own k-th best is not among the best
            last = np.maximum(last, np.partition(scores, -self.k, 1)[:, -self.k].astype("i8"))
        at, c = np.nonzero((scores >= last[:, None]) & (scores > self.NONE))
        if not len(at):
            return rows[:0]
        touched = np.unique(at)
        own = rows[touched]
        of = np.concatenate([at, np.repeat(touched, self.k)])
        score = np.concatenate([scores[at, c].astype("i8"), self.score[own].ravel()])
        vec = np.concatenate([ids[c], self.vec[own].ravel()])
        order = np.lexsort((vec, -score, of))
        first = order[np.searchsorted(of[order], touched)[:, None] + np.arange(self.k)]
        self.score[own], self.vec[own] = score[first], vec[first]
        return own

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query_id, vec_id and score of what was found, best first."""
        row, at = np.nonzero(self.score > self.NONE)
        return self.ids[row], self.vec[row, at], self.score[row, at]


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v: floor(scale * x) of every component, of the rows that take part."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = rows.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    return fine.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("bigint")).alias("v"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, tree_rows: int = 8_192, query_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row whose vec_id is divisible by `every`.

    Rows are dealt by hash into trees of about tree_rows, each built once and stored, and
    queries into blocks of query_rows at most.  Trees and blocks are dealt into a grid
    (`grid`): a task has some blocks and takes some trees, one after the other, so that
    what is sent grows with the table.  A query's best so far bound its search of the next
    tree, and the k best of each task meet in one sum per query.  Neither side is broadcast.

    Vectors that are null or hold null or non-finite components, and rows with a null
    vec_id, take no part.  Vectors of another length than the query's are not compared
    with it.  Equal scores: the smaller vec_id.  Rows that repeat a vec_id are candidates
    each, but not for a query of that id; as queries they share one list of the k best of
    all of them.  Other columns are not read.  An empty table gives no rows.
    """
    rows = whole_vectors(vectors)
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    trees = max(1, -(-counts["n"] // tree_rows))
    across, down = grid(counts["n"], counts["q"], trees)
    blocks = max(down, -(-counts["q"] // query_rows))
    key = lambda n: F.struct(F.size("v").alias("width"), F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("part")).alias("k")

    def made(pack):
        def run(key, part):
            ids, v = part.column("vec_id").to_numpy(), _matrix(part.column("v"))
            order = np.lexsort((*v.T[::-1], ids))
            return pa.table({"width": pa.array([v.shape[1]], pa.int32()), "part": pa.array([key[0].as_py()["part"]], pa.int64()), "blob": pa.array([pack(ids[order], v[order])], pa.binary())})

        return run

    shape = "width int, part bigint, blob binary"
    plots = cut(rows.select(key(trees), "vec_id", "v").groupBy("k").applyInArrow(made(lambda ids, v: MTree(ids, v).packed()), shape))
    asked = rows.where(F.col("vec_id") % every == 0).select(key(blocks), "vec_id", "v").groupBy("k").applyInArrow(made(lambda ids, v: pickle.dumps((ids, v.astype(_narrow(v))), protocol=5)), shape)
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select("width", copies(across).alias("x"), F.pmod("part", F.lit(down)).cast("int").alias("y"), F.lit(False).alias("tree"), "blob")
    plots = plots.select("width", F.pmod("part", F.lit(across)).cast("int").alias("x"), copies(down).alias("y"), F.lit(True).alias("tree"), "blob")
    met = asked.unionByName(plots).repartition(min(2000, 2 * across * down), "width", "x", "y").sortWithinPartitions("width", "x", "y", "tree")

    def search(batches):
        at, blocks, best = None, [], None

        def found():
            ids, vec, score = best.found() if best else (np.zeros(0, "i8"),) * 3
            for a in range(0, len(ids), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000], pa.int64()) for x in (ids, vec, score)], names=["query_id", "vec_id", "score"])

        for b in batches:
            for *here, tree, blob in zip(*(b.column(n).to_pylist() for n in ("width", "x", "y", "tree")), b.column("blob")):
                if here != at:
                    yield from found()
                    at, blocks, best = here, [], None
                if not tree:
                    blocks.append(pickle.loads(blob.as_py()))
                elif blocks or best:  # (trees come after all blocks)
                    if best is None:
                        best, blocks = Best(np.concatenate([i for i, _ in blocks]), np.concatenate([v for _, v in blocks]), k), []
                    MTree.unpacked(blob.as_py()).search_all(best)
        yield from found()

    found = met.mapInArrow(tidied(search), "query_id bigint, vec_id bigint, score bigint")
    # (a short list for every query, k from each task)
    listed = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return listed.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def grid(rows: int, queries: int, trees: int, most: int = 1_000_000) -> tuple[int, int]:
    """Into how many parts trees and queries are dealt: queries are sent once for each part of the trees, trees once for each part of the queries.

    128 tasks or more on large tables, so that none has more than `most` rows or queries.
    """
    across = min(trees, max(64, -(-rows // most)))
    return across, max(1, min(-(-queries // 64), max(-(-queries // most), min(8, -(-128 // across)))))


def _narrow(v: np.ndarray) -> np.dtype:
    return np.min_scalar_type(-int(np.abs(v).max())) if v.size else np.dtype("i1")


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), "i8").reshape(len(flat), -1)


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""
