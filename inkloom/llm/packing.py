"""Packing of tokenized documents into training sequences, first-fit decreasing."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.bpe import loaded
from inkloom.llm.common import arrow_slices, tidied
from inkloom.llm.library import WordIds

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class CapacityTree:
    """A tournament tree over bins: each inner node holds the most room of any bin below it."""

    def __init__(self, bins: int, room: int):
        self.width = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.width)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for size, and the room it had; the room is taken."""
        room, node = self.room, 1
        while node < self.width:
            node *= 2
            if room[node] < size:
                node += 1
        had = room[node]
        room[node] = had - size
        at = node >> 1
        while at:
            best = room[2 * at] if room[2 * at] >= room[2 * at + 1] else room[2 * at + 1]
            if room[at] == best:
                break
            room[at] = best
            at >>= 1
        return node - self.width, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item, the largest items placed first (ties: in the given order)."""
    tree = CapacityTree(max(1, len(sizes)), capacity)
    bins, offsets = np.empty(len(sizes), "i8"), np.empty(len(sizes), "i8")
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i], had = tree.place(int(sizes[i]))
        offsets[i] = capacity - had
    return bins, offsets


def cut_documents(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of at most `length` ids of every document, its ids followed by end_id."""

    def run(batches):
        words = loaded(WordIds, vocabulary)
        for b in arrow_slices(batches, "text", 16 << 20):
            ids, ends = words.ids(b.column("text"))
            stream = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
            size = np.diff(ends, prepend=0)
            count = -(-size // length)
            doc = np.repeat(np.arange(len(size)), count)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * length
            piece = np.minimum(length, size[doc] - start)
            first, raw = (ends - size)[doc] + start, memoryview(stream.tobytes())
            sums = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(first.tolist(), (first + piece).tolist())]
            rows = [b.column("doc_id").cast(pa.int64()).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, piece, sums, size[doc]))]
            yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), PIECES)


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, end_id: int = 1, group_pieces: int = 20_000) -> DataFrame:
    """Pack whole documents into sequences of at most `length` tokens.

    A document is cut at multiples of `length`; the pieces are dealt into randomised
    groups of about group_pieces, and each group is packed on its own, so neither a
    shuffle of texts nor a view of all documents is needed.  A null text is an empty
    one: its piece holds the end id alone.  Rows with a null or repeated doc_id are
    documents of their own.  Other columns are not read.  An empty table gives no rows.
    """
    pieces = cut_documents(docs, vocabulary, length, end_id)
    groups = max(1, -(-docs.count() // group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))

    def packed(key, part):
        part = part.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(part.column("length").to_numpy(), length)
        first = key[0].as_py() << 32
        return part.drop_columns(["_group"]).append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("_group").applyInArrow(packed, PIECES + ", sequence_id bigint, offset bigint")
