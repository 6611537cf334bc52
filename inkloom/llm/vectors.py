"""Near-duplicate vectors by cross-polytope hashing.

A hash is the nearest signed axis after three rounds of random signs and a fast Hadamard
transform; a bucket joins the hashes of several rotations.  A vector enters, in each
table, the bucket of its best axes and those that swap one axis for the runner-up
(multiprobe).  Pairs of a bucket are verified in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import cut, partitions, tidied
from inkloom.llm.graph import components

#: Vectors compared at once in one task; larger buckets are compared block against block.
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], 2).reshape(len(x), n)
        h *= 2
    return x


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1])) / math.sqrt(x.shape[1])
    return x


def buckets_of(x: np.ndarray, table: int, rotations: int) -> np.ndarray:
    """Bucket numbers of unit vectors in a table: the best, then one for each rotation's runner-up."""
    width = 1 << max(1, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    best, next_ = [], []
    for r in range(rotations):
        y = rotated(x, table * 64 + r)
        order = np.argsort(-np.abs(y), axis=1)[:, :2]
        axis = 2 * order + (np.take_along_axis(y, order, 1) < 0)
        best.append(axis[:, 0])
        next_.append(axis[:, 1])
    sides = 2 * width
    codes = []
    for probe in range(rotations + 1):
        code = np.full(len(x), table, "i8")
        for r in range(rotations):
            code = code * sides + (next_[r] if probe == r + 1 else best[r])
        codes.append(code)
    return np.stack(codes, 1)


def usable(vectors: list) -> np.ndarray:
    """Which entries are vectors with finite components only and not zero."""
    return np.array([v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for v in vectors], bool)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), "f8").reshape(len(flat), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Links:
    """A union-find over the rows of a block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def spanning_links(x: np.ndarray, y: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Links between rows of x (and those of y, numbered after them) that span all their links."""
    own = y is None
    z = x if own else y
    links, out = Links(len(x) + (0 if own else len(z))), []
    for at in range(0, len(x), 256):
        i, j = np.nonzero(x[at : at + 256] @ z.T >= least)
        i = i + at
        if own:
            i, j = i[i < j], j[i < j]
        else:
            j = j + len(x)
        for a, b in zip(i.tolist(), j.tolist()):
            if links.join(a, b):
                out.append((a, b))
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.95, tables: int = 8) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding).

    Equal vectors are one class, named by its smallest vec_id.  Buckets give links that
    span the pairs found; within each component all pairs are then counted, so n_links
    also holds pairs that no bucket held.  A pair is linked if its cosine, in double
    precision, is at least `least`.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, as do rows with a null vec_id (component_id null, kept false).  Vectors
    of different lengths are never linked.  Rows that repeat a vec_id count as separate
    vectors.  Other columns are not read.  An empty table gives no rows.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    bad = F.col("vec_id").isNull() | F.col("v").isNull() | (F.size("v") == 0) | F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | ~F.exists("v", lambda c: c != 0)
    marked = rows.withColumn("ok", ~F.coalesce(bad, F.lit(True))).withColumn("v", F.when(F.col("ok"), F.transform("v", lambda c: c + 0.0)))
    classes = cut(marked.where("ok").groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    total = classes.count()
    # buckets of a table: enough that a bucket of unrelated vectors stays small
    rotations = max(2, math.ceil(math.log(max(2, total)) / math.log(128) - 0.5))
    tables = tables * 2 ** (rotations - 2)
    links = cut(_bucket_links(classes, least, tables, rotations))
    label = components(links)
    counted = _degrees(classes, label, least)
    named = classes.join(counted, "node", "left").select("v", F.coalesce("component", "node").alias("component_id"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = marked.join(named, "v", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _bucket_links(classes: DataFrame, least: float, tables: int, rotations: int) -> DataFrame:
    spark = classes.sparkSession

    def hashed(batches):
        for b in batches:
            node, v = b.column("node").to_numpy(), b.column("v")
            sizes = np.array([len(x) for x in v], "i8")
            for size in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == size)
                x = _unit(_matrix(v.take(pa.array(mine))))
                for t in range(tables):
                    code = buckets_of(x, t, rotations) * 8191 + size
                    probes = code.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(code.ravel()), pa.array(np.repeat(node[mine], probes))], names=["bucket", "node"])

    entries = classes.select("node", "v").mapInArrow(tidied(hashed), "bucket bigint, node bigint").distinct()
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    placed = entries.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a row of block i meets every block: pairs of blocks (i, j), i <= j, each compared in one task
    met = placed.select("bucket", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("bucket", "node", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    full = met.join(classes.select("node", "v"), "node")
    task = F.when(F.col("lo") + F.col("hi") > 0, F.xxhash64("bucket", "lo", "hi")).otherwise(F.xxhash64("bucket"))
    dealt = full.withColumn("task", F.pmod(task, F.lit(1 << 40))).repartition(partitions(spark), "task").sortWithinPartitions("task", "bucket", "lo", "hi", "block", "node")

    def compare(batches):
        def flush(rows):
            out = []
            key, block, node, v = rows
            if len(node) > 1:
                x, first = _unit(np.array(v)), np.array([b == key[1] for b in block])
                node = np.array(node)
                if key[1] == key[2]:
                    out = [(node[a], node[b]) for a, b in spanning_links(x, None, least)]
                elif first.any() and not first.all():
                    both = np.concatenate([node[first], node[~first]])
                    out = [(both[a], both[b]) for a, b in spanning_links(x[first], x[~first], least)]
            return out

        rows, found = None, []
        for b in batches:
            for bucket, lo, hi, block, node, v in zip(*(b.column(c).to_pylist() for c in ("bucket", "lo", "hi", "block", "node", "v"))):
                if rows is None or rows[0] != (bucket, lo, hi):
                    found += flush(rows) if rows else []
                    rows = ((bucket, lo, hi), [], [], [])
                for column, value in zip(rows[1:], (block, node, v)):
                    column.append(value)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
                found = []
        found = flush(rows) if rows else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return dealt.select("bucket", "lo", "hi", "block", "node", "v").mapInArrow(tidied(compare), "a bigint, b bigint").distinct()


def _degrees(classes: DataFrame, label: DataFrame, least: float) -> DataFrame:
    """(node, component, linked): how many vectors of other classes each class of a component is linked with.

    A component is dealt into blocks; a task has one block and, in turn, the component's
    others, so that no task holds a component and only counts leave it.
    """
    spark = classes.sparkSession
    sizes = label.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = label.join(sizes, "component").join(classes, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = members.select("component", "node", "v", "copies", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    mine = F.when(F.col("block") == F.col("other"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    # (task: block `at` of the component; its own rows first, then all that it is compared with)
    dealt = met.select("component", "node", "v", "copies", F.col("other").alias("at"), F.explode(mine).alias("turn"))
    dealt = dealt.withColumn("task", F.xxhash64("component", "at")).repartition(partitions(spark), "task").sortWithinPartitions("task", "component", "at", "turn", "node")

    def count(batches):
        key, nodes, vs, against, done = None, [], [], [], []
        x, linked = None, None

        def settle():
            nonlocal against, x, linked
            if x is None:
                x, linked = _unit(np.array(vs)), np.zeros(len(vs))
            if against:
                y, n = _unit(np.array([v for v, _ in against])), np.array([c for _, c in against], "f8")
                linked += (x @ y.T >= least) @ n
                against = []

        def close():
            settle()
            done.extend(zip(nodes, [key[0]] * len(nodes), linked.tolist()))

        for b in batches:
            for component, node, v, copies, at, turn in zip(*(b.column(c).to_pylist() for c in ("component", "node", "v", "copies", "at", "turn"))):
                if key != (component, at):
                    if key:
                        close()
                    key, nodes, vs, against, x, linked = (component, at), [], [], [], None, None
                    own = {}
                if turn == 0:
                    nodes.append(node)
                    vs.append(v)
                    own[node] = copies
                else:
                    against.append((v, copies))
                    if len(against) >= BLOCK:
                        settle()
            if done:
                yield _counts(done)
                done = []
        if key:
            close()
            yield _counts(done)

    def _counts(done):
        return pa.RecordBatch.from_arrays([pa.array([int(x[0]) for x in done], pa.int64()), pa.array([int(x[1]) for x in done], pa.int64()), pa.array([int(x[2]) for x in done], pa.int64())], names=["node", "component", "n"])

    counted = dealt.select("component", "node", "v", "copies", "at", "turn").mapInArrow(tidied(count), "node bigint, component bigint, n bigint")
    own = classes.select("node", "copies")
    return counted.join(own, "node").select("node", "component", (F.col("n") - F.col("copies")).alias("linked"))


NEAR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS n, vec_id AS c FROM embeddings UNION SELECT l.b, reach.c FROM reach JOIN l ON l.a = reach.n),
low AS (SELECT n, min(c) AS component_id FROM reach GROUP BY n)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, low.component_id, e.vec_id = low.component_id AS kept
FROM embeddings e JOIN low ON low.n = e.vec_id"""
