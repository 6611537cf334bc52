"""Exact self-join of documents by Jaccard similarity of their word shingles.

Two sets of sizes a <= b with Jaccard similarity t differ in at most
(1 - t) / (1 + t) * (a + b) elements.  Sizes are cut into bands.  Within the scheme of a
band a hash deals every shingle into one of m segments; a pair is looked for in the band
of its larger set, so a set enters its own band and those that hold larger partners.

* Whole segments: each difference spoils one segment, so of m > H segments at least
  m - H agree.  A set's signatures are its segments' contents.
* One-deletion neighbourhoods: of m > H / 2 segments at least m - H // 2 differ in at
  most one element.  Signatures are the segments' contents, and these less any one
  element.

Segments of fewer than two shingles select little and do not count; a set that has
so many of them that a partner might be missed is dealt again under the next seed, as
often as needed.  Of two partners the one that needs fewer seeds shares with the other a
seed under which it misses nothing; sets that no seed serves (small ones, at low
percentages) share a shingle, and have each of theirs as a signature besides.  For each
band the cheaper scheme is taken, by the rows that it makes and the pairs that its weak
signatures are expected to bring.  A set of n shingles costs m rows by whole segments and
n + m by neighbourhoods: these pay where 2 m is more than n + m, in small bands.

Classes that share a signature form a run, and runs with the same smallest class form a
group: every pair to be found lies within a group.  A group is dealt into blocks, and each
pair of blocks goes to one task, which counts the intersections of its sets through an
inverted index, confirms links on the words themselves and returns links that span all
those it found.  So neither pairs nor a whole group ever leave or enter a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import arrow_slices, cut, partitions, texts_of, tidied
from inkloom.llm.graph import components

U64 = np.uint64
#: Odd multipliers that mix words and shingles.
WORD_STEP, MIX_A, MIX_B = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Classes of a group that one task takes at once from either side.
BLOCK = 1024
MOST_SEEDS = 64


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    segments: int
    delete: bool  # one-deletion neighbourhoods


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


def words_of(text: str) -> list[bytes]:
    """Words of a text between ASCII white space, A-Z as lower case."""
    return text.encode().lower().split()


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


_HASHES = WordHashes()


def forget_words() -> None:
    _HASHES.clear()


def shingle_hashes(text: str, n: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the n-word shingles, in ascending order."""
    words = words_of(text)
    if not words:
        return np.empty(0, U64)
    w = np.fromiter(map(_HASHES.__getitem__, words), U64, len(words))
    if len(w) < n:
        total = U64(len(w))
        with np.errstate(over="ignore"):
            for x in w:
                total = total * WORD_STEP + x
        return mixed(np.array([total], U64))
    total = np.zeros(len(w) - n + 1, U64)
    for j in range(n):
        total = total * WORD_STEP + w[j : len(w) - n + 1 + j]
    return np.unique(mixed(total))


def shingle_set(text: str, n: int = 5) -> set:
    words = words_of(text)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[j:] for j in range(n))))


def differences(a: int, b: int, percent: int) -> int:
    """The most elements in which sets of sizes a and b can differ at that Jaccard percentage."""
    return (a + b) * (100 - percent) // (100 + percent)


def band_edges(largest: int, percent: int) -> list[tuple[int, int]]:
    out, low = [], 1
    while low <= largest:
        high = max(low, low * 100 // percent - 1) if low > 8 else low
        out.append((low, high))
        low = high + 1
    return out


def spoiled_segments(n: int, band: Band, percent: int) -> int:
    """The most segments that differences with a partner can take from a set of size n in a band."""
    most = differences(n, min(band.high, n * 100 // percent), percent)
    return most // 2 if band.delete else most


def margin(n: int, band: Band, percent: int) -> float:
    """Expected useful segments beyond those needed, in standard deviations (shingles fall as by chance)."""
    m, r = band.segments, n / band.segments
    weak = (1 + r) * math.exp(-r) if m > 1 else 0.0
    return (m * (1 - weak) - spoiled_segments(n, band, percent) - 1) / math.sqrt(m * weak * (1 - weak) + 0.01)


def choose(low: int, high: int, sets: int, percent: int) -> Band:
    """The cheaper scheme for a band, by the signature rows of a set (again for each seed it needs) and the pairs expected from one-shingle contents."""
    if differences(high, high, percent) == 0:
        return Band(low, high, 1, False)
    least = -(-low * percent // 100)
    sizes = sorted({least, low, (low + high) // 2, high})
    plans = []
    for delete in (False, True):
        for m in range(1, max(2, high) + 1):
            band = Band(low, high, m, delete)
            if m <= max(spoiled_segments(n, band, percent) for n in sizes):
                continue
            got = math.inf if m == 1 else min(margin(n, band, percent) for n in sizes)
            seeds = 1 / max(0.02, 0.5 * math.erfc(-got / math.sqrt(2)))
            r = high / m
            single = m * r * r * math.exp(-r) if delete and m > 1 else 0.0
            plans.append((sets * seeds * ((m + high if delete else m) + single * math.log2(1 + sets)), delete, m))
            if got >= 3:
                break
    _, delete, m = min(plans)
    return Band(low, high, m, delete)


def signatures(shingles: np.ndarray, band_no: int, band: Band, percent: int) -> np.ndarray:
    """Signatures of a set in a band, under as many seeds as it needs."""
    n = len(shingles)
    spoiled = spoiled_segments(n, band, percent)
    out = []
    value = mixed(shingles ^ WORD_STEP)
    m = band.segments
    for seed in range(MOST_SEEDS):
        salt = U64((band_no * MOST_SEEDS + seed + 1) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)
        segment = ((mixed(shingles ^ salt) >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        segment, v = segment[order], value[order]
        first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        size = np.diff(np.r_[first, n])
        whole = np.add.reduceat(v, first)
        place = mixed(segment[first].astype(U64) + salt)
        useful = size >= 2 if n > 1 and m > 1 else np.ones(len(size), bool)
        # (a segment of two less one element meets a segment of one)
        shown = useful | band.delete
        out.append(mixed(whole[shown] + place[shown]))
        if band.delete:
            of = np.repeat(np.arange(len(first)), size)
            less = useful[of] & (size[of] >= 2)
            out.append(mixed(whole[of][less] - v[less] + place[of][less]))
        if int(useful.sum()) - spoiled >= 1:
            return np.concatenate(out)
    out.append(mixed(value + U64(band_no * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)))
    return np.concatenate(out)


def describe(docs: DataFrame, n: int = 5, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Set size, 128-bit fingerprint and class number of every document's shingles (null for an empty set)."""
    kept = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_shingles bigint, print binary, node bigint"])

    def run(batches):
        for b in arrow_slices(batches, "_text"):
            sizes, prints, nodes = [], [], []
            for t in texts_of(b.column("_text")):
                s = shingle_hashes(t, n)
                sizes.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                nodes.append(class_number(prints[-1], {}) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(nodes, pa.int64())], names=[*(f.name for f in kept), "n_shingles", "print", "node"])

    return docs.select(*(f.name for f in kept), F.col("text").alias("_text")).mapInArrow(tidied(run, forget_words), schema)


def plan_bands(described: DataFrame, percent: int) -> tuple[list[Band], int]:
    """Schemes of all bands from the counts by size (a sum over a bounded number of bands), and the signature rows to expect."""
    level = F.when(F.col("n_shingles") <= 8, F.col("n_shingles")).otherwise((F.log2("n_shingles") * 8).cast("long") + 100)
    counted = described.where("n_shingles > 0").groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.max("n_shingles").alias("high"), F.sum("n_shingles").alias("total")).collect()
    if not counted:
        return [], 0
    by_size = sorted((r["high"], r["n"]) for r in counted)
    bands = [choose(lo, hi, sum(n for s, n in by_size if lo <= s <= hi) + 1, percent) for lo, hi in band_edges(by_size[-1][0], percent)]
    return bands, int(0.7 * sum(r["total"] for r in counted)) + 1


def bands_for(size: int, bands: list[Band], lows: np.ndarray, percent: int) -> range:
    """The bands that hold a set's size or that of larger partners."""
    first = int(np.searchsorted(lows, size, side="right")) - 1
    last = int(np.searchsorted(lows, size * 100 // percent, side="right")) - 1
    return range(first, last + 1)


def class_number(fingerprint: bytes, moved: dict[bytes, int]) -> int:
    """A class's number: the first 64 bits of its fingerprint, or what `moved` has for one whose bits another class has too."""
    return moved[fingerprint] if fingerprint in moved else int.from_bytes(fingerprint[:8], "little", signed=True)


def packed(nodes: np.ndarray, place: np.ndarray, sig: np.ndarray) -> bytes:
    """Signatures of one bucket: the classes that have any, and for each signature the place of its class and its upper 40 bits.

    Signatures that agree in these and in the bucket but differ otherwise only make a run that verification parts.
    """
    held, at = np.unique(place, return_inverse=True)
    upper = sig >> U64(24)
    wide = "<u2" if len(held) <= 65536 else "<u4"
    return b"".join([np.array([len(held), len(sig)], "<u4").tobytes(), nodes[held].astype("<i8").tobytes(), at.astype(wide).tobytes(), (upper >> U64(8)).astype("<u4").tobytes(), (upper & U64(255)).astype("u1").tobytes()])


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The signatures' upper bits and their classes."""
    held, n = np.frombuffer(blob, "<u4", 2).tolist()
    wide = np.dtype("<u2" if held <= 65536 else "<u4")
    nodes = np.frombuffer(blob, "<i8", held, 8)
    at = 8 + 8 * held
    place = np.frombuffer(blob, wide, n, at)
    high = np.frombuffer(blob, "<u4", n, at + wide.itemsize * n).astype("u8")
    low = np.frombuffer(blob, "u1", n, at + (wide.itemsize + 4) * n)
    return high << U64(8) | low, nodes[place]


def candidate_runs(docs: DataFrame, bands: list[Band], rows: int, n: int, percent: int, moved: dict[bytes, int]) -> DataFrame:
    """(group, node): the classes that share a signature, and the smallest of them, with repeats.

    Copies of a class send its signatures once for each task that meets them, and runs
    are rows, so that neither many copies nor a signature of many classes fill a row.
    """
    spark = docs.sparkSession
    buckets = max(partitions(spark), rows // 2_000_000)
    lows = np.array([b.low for b in bands], "i8")

    def emit(batches):
        met = set()
        for b in arrow_slices(batches, "text", 32 << 20):
            sigs, nodes = [], []
            if len(met) > 500_000:
                met.clear()
            for text in texts_of(b.column("text")):
                s = shingle_hashes(text, n)
                if len(s):
                    number = class_number(xxhash.xxh3_128_digest(s.tobytes()), moved)
                    if number in met:
                        continue
                    met.add(number)
                    nodes.append(number)
                    sigs.append(np.concatenate([signatures(s, k, bands[k], percent) for k in bands_for(len(s), bands, lows, percent)]))
            if not sigs:
                continue
            sig, place = np.concatenate(sigs), np.repeat(np.arange(len(sigs), dtype="u4"), [len(x) for x in sigs])
            bucket = (sig % U64(buckets)).astype("i4")
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            own = np.array(nodes, "i8")
            blobs = [packed(own, place[x], sig[x]) for x in np.split(order, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(blobs, pa.binary())], names=["bucket", "records"])

    def collide(part):
        record = np.dtype([("sig", "<u8"), ("doc", "<i8")])
        read = [unpacked(x) for x in part.column("records").to_pylist()]
        made = np.empty(sum(len(x) for x, _ in read), record)
        made["sig"], made["doc"] = np.concatenate([x for x, _ in read]), np.concatenate([y for _, y in read])
        del read
        made = np.unique(made)
        sig = made["sig"]
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        sizes = np.diff(np.r_[starts, len(sig)])
        seen, runs = set(), []
        for at, k in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            members = made["doc"][at : at + k]
            digest = xxhash.xxh3_128_digest(members.tobytes())
            if digest not in seen:
                seen.add(digest)
                runs.append(members)
        many = np.array([len(x) for x in runs], "i8")
        node = np.concatenate(runs) if runs else np.empty(0, "i8")
        pair = np.unique(np.stack([np.repeat(node[np.cumsum(many) - many], many), node], 1), axis=0) if len(node) else np.empty((0, 2), "i8")
        return pa.table({"group": pa.array(pair[:, 0]), "node": pa.array(pair[:, 1])})

    return docs.select("text").mapInArrow(tidied(emit, forget_words), "bucket int, records binary").groupBy("bucket").applyInArrow(collide, "group bigint, node bigint")


def spanning_links(texts: list[str], n: int, percent: int) -> list[tuple[int, int]]:
    """Links between texts that span all of their links.

    A set of which more than the permitted share is found in no other set has no link.
    Of the others, first the one whose shingles are most common is compared with all, then
    in turn each that is not yet in its component: pairs within that component need no
    comparison.
    """
    sets = [shingle_hashes(t, n) for t in texts]
    sizes = np.array([len(s) for s in sets], "i8")
    owner = np.repeat(np.arange(len(sets)), sizes)
    shingle, met = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(met, minlength=len(shingle))
    shared = np.bincount(owner[often[met] > 1], minlength=len(sets))
    live = 100 * shared >= percent * sizes
    if live.sum() < 2:
        return []
    kept = live[owner]
    order = np.argsort(met[kept], kind="stable")
    holders = owner[kept][order]
    ends = np.cumsum(np.bincount(met[kept], minlength=len(shingle)))
    begins = np.concatenate([[0], ends[:-1]])
    first = np.cumsum(sizes) - sizes
    root = np.arange(len(sets))
    words: dict[int, set] = {}
    out = []

    def words_at(i: int) -> set:
        if i not in words:
            words[i] = shingle_set(texts[i], n)
        return words[i]

    weight = np.bincount(owner, often[met], len(sets)) / np.maximum(1, sizes)
    turns = sorted(np.flatnonzero(live).tolist(), key=lambda i: (-weight[i], i))
    for k, a in enumerate(turns):
        if k and root[a] == root[turns[0]]:
            continue
        mine = met[first[a] : first[a] + sizes[a]]
        both = np.bincount(np.concatenate([holders[x:y] for x, y in zip(begins[mine].tolist(), ends[mine].tolist())]), minlength=len(sets))
        for b in np.flatnonzero(100 * both >= percent * (sizes[a] + sizes - both)).tolist():
            if root[b] == root[a]:
                continue
            common = len(words_at(a) & words_at(b))
            if 100 * common >= percent * (len(words_at(a)) + len(words_at(b)) - common):
                out.append((a, b))
                root[root == max(root[a], root[b])] = min(root[a], root[b])
    return out


def group_links(members: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) of classes: links that span those of all groups; members: (group, node), distinct.

    docs has doc_id, text and text_hash; the text of a class is that of its first document.
    """
    # (written, so that the join has plain shuffles on both sides and a large group can be split)
    blocks = cut(members.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    placed = members.join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = placed.select("group", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("group", "node", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    of = classes.join(members.select("node").distinct(), "node").select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    texts = docs.join(of, ["doc_id", "text_hash"]).select("node", "text")

    def link(part):
        nodes = part.column("node").to_pylist()
        text = dict(zip(nodes, part.column("text").to_pylist()))
        nodes = sorted(text)
        found = spanning_links([text[x] for x in nodes], n, percent)
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([nodes[j] for _, j in found], pa.int64())})

    return met.join(texts, "node").groupBy("group", "lo", "hi").applyInArrow(link, "a bigint, b bigint").distinct()


def similar_components(docs: DataFrame, n: int = 5, percent: int = 80, by_text: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text).

    With `by_text` also text_hash (xxhash64 of text) and `first`: whether the row has the
    smallest (doc_id, text_hash) of its component; rows linked with nothing have it.

    Documents of one shingle set are one class.

    Null, empty and blank texts have the empty set and are linked with nothing.  A row
    with a null doc_id is described but linked with nothing, and its component_id is
    null.  Rows that repeat a doc_id with another text are separate documents of one id.
    Other columns are not read.  An empty table gives no rows.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    described = cut(describe(keyed, n, ("doc_id", "text_hash")))
    linkable = described.where("print IS NOT NULL AND doc_id IS NOT NULL")
    classes = cut(linkable.groupBy("print").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.max("n_shingles").alias("n_shingles"), F.max("node").alias("node")))
    bands, rows = plan_bands(classes, percent)
    if not bands:
        return described.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *([F.col("text_hash"), F.lit(True).alias("first")] if by_text else []))
    # classes whose first 64 bits agree (about none below 10^9 classes) get numbers of their own
    shared = classes.groupBy("node").agg(F.count("*").alias("k"), F.collect_list("print").alias("prints")).where("k > 1").collect()
    moved = {bytes(x): int.from_bytes(xxhash.xxh3_64_digest(bytes(x) + b"again"), "little", signed=True) for r in shared for x in r["prints"]}
    if moved:
        classes = cut(classes.withColumn("node", F.udf(lambda x: class_number(bytes(x), moved), "bigint")("print")))
    present = keyed.where("doc_id IS NOT NULL")
    members = cut(candidate_runs(present, bands, rows, n, percent, moved).distinct())
    label = components(group_links(members, classes, present, n, percent))
    grouped = classes.join(label, "node", "left").select("print", F.coalesce("component", "node").alias("component"), F.col("first" if by_text else "first.doc_id").alias("lowest"))
    lowest = grouped.groupBy("component").agg(F.min("lowest").alias("component_id"))
    named = grouped.join(lowest, "component").select("print", "component_id")
    if by_text:
        of = F.col("component_id")
        return described.drop("node").join(named, "print", "left").select(
            "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(of["doc_id"], "doc_id")).alias("component_id"), "text_hash",
            F.coalesce((of["doc_id"] == F.col("doc_id")) & (of["text_hash"] == F.col("text_hash")), F.lit(True)).alias("first"),
        )
    return (
        described.drop("node").join(named, "print", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    )



#: The same over the table documents as DuckDB SQL, by the shingles that pairs share.
COMPONENTS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM i),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.b, reach.c FROM reach JOIN l ON l.a = reach.d),
low AS (SELECT d, min(c) AS component_id FROM reach GROUP BY d)
SELECT o.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, low.component_id
FROM documents o LEFT JOIN n ON n.doc_id = o.doc_id JOIN low ON low.d = o.doc_id"""
