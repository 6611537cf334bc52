"""Encoding and decoding of whole texts with a public byte-level vocabulary."""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.bpe import ByteBpe, loaded
from inkloom.llm.common import arrow_slices, texts_of, tidied


def bpe_encode(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, `ids` (array of int) of every row's text.

    Null and empty texts have no ids; rows are independent, so ties and repeated rows
    need no care; other columns are not read.
    """
    return _mapped(docs, vocabulary, text, keep, "ids array<int>", _ids)


def bpe_decode(encoded: DataFrame, vocabulary: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, `text`: the text that an array of ids spells; null ids are an empty text."""
    kept = [f for f in encoded.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["text string"])

    def run(batches):
        bpe = loaded(ByteBpe, vocabulary)
        for b in batches:
            out = [bpe.decode(x or []).decode() for x in b.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(out, pa.string())], names=[*(f.name for f in kept), "text"])

    return encoded.select(*(f.name for f in kept), F.col(ids).alias("_ids")).mapInArrow(tidied(run), schema)


def round_trip_digest(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every text, decode the ids again, and return digests of both: key, n_tokens, ids_sha256, decoded_sha256.

    A null text is an empty one (no ids).  Whole texts are read, whatever their length;
    rows are independent, so null keys, ties and repeated rows need no care; other columns
    are not read, whatever their names.  An empty table gives no rows.
    """
    return _mapped(docs, vocabulary, text, (key,), "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digest)


def _ids(bpe: ByteBpe, texts: list[str]):
    out = [np.frombuffer(bpe.encode(t), "<i4") for t in texts]
    return [pa.array(out, pa.list_(pa.int32()))]


def _digest(bpe: ByteBpe, texts: list[str]):
    n, ids_sha, text_sha = [], [], []
    for t in texts:
        ids = bpe.encode(t)
        n.append(len(ids) // 4)
        ids_sha.append(sha256(ids).hexdigest())
        text_sha.append(sha256(bpe.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
    return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]


def _mapped(docs, vocabulary, text, keep, columns, make):
    kept = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), columns])
    names = [f.name for f in kept] + [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        bpe = loaded(ByteBpe, vocabulary)
        for b in arrow_slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *make(bpe, texts_of(b.column("_text")))], names=names)

    return docs.select(*(f.name for f in kept), F.col(text).alias("_text")).mapInArrow(tidied(run), schema)
