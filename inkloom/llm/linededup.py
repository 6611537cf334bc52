"""Removal of repeated multi-line passages, by content-defined chunks of lines.

All of it is built-in functions.  Blank lines aside, lines get a hash (the first 32 bits of
their md5); the rolling hash of a line is a weighted sum over it and the line before.  A
chunk ends after a line whose rolling hash is a multiple of `divisor`, so a boundary
depends on two lines only and an insertion moves no boundary but those beside it.  A
repeated passage begins and ends anywhere, though, so chunks are found at two levels: those
between the boundaries, and every two lines in a row, which are the smallest chunks of
more than a line.  A place of a chunk that is not its first goes, after its bytes are
compared with those of the first; so a passage of two lines or more goes from its first line to its
last, wherever it stands.  Where a long chunk goes, the small ones within it need no care:
only chunks that no other holds are fetched and compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.llm.common import cut

#: Weight of the earlier line in the rolling hash.
WEIGHT = 31
#: A line that is not blank (the same in both SQL dialects).
FULL = r"[^ \t\r]"
OWN = ("n_lines", "n_removed", "_mark", "_of", "_spans", "_lines", "_at", "_hash", "_ends", "_gone", "_v")


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column by a generator of one row, so that lambdas that refer to it do not work it out anew for each element."""
    return df.select("*", F.explode(F.array(F.struct(value.alias("v")))).alias("_v")).withColumn(name, F.col("_v.v")).drop("_v")


def _body(start: Column, n_lines: Column) -> Column:
    return F.array_join(F.slice("_lines", start + 1, n_lines), "\n")


def chunks_of(docs: DataFrame, divisor: int = 4) -> DataFrame:
    """(_mark, start, n_lines, h) of all chunks of both levels of docs (_mark, text); h is the md5 of the chunk's bytes.

    A chunk begins and ends with a line that is not blank and has two such lines or more.
    """
    lines = _held(docs, "_lines", F.split("text", "\n", -1))
    full = _held(lines, "_at", F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: F.col("_lines")[i].rlike(FULL))).where(F.size("_at") > 1)
    hashed = _held(full, "_hash", F.transform("_at", lambda i: _line_hash(F.col("_lines")[i])))
    last = F.size("_at") - 1

    def ends(j: Column) -> Column:
        rolling = F.col("_hash")[j] + WEIGHT * F.when(j > 0, F.col("_hash")[j - 1]).otherwise(0)
        return (rolling % divisor == 0) | (j == last)

    ended = _held(hashed, "_ends", F.filter(F.sequence(F.lit(0), last), ends))
    bounds = F.transform("_ends", lambda e, i: F.struct(F.when(i > 0, F.col("_ends")[i - 1] + 1).otherwise(0).alias("a"), e.alias("b")))
    pairs = F.transform(F.sequence(F.lit(0), last - 1), lambda j: F.struct(j.alias("a"), (j + 1).alias("b")))
    # (a chunk of two lines is one of the pairs already)
    spans = F.concat(pairs, F.filter(bounds, lambda c: c["b"] - c["a"] > 1))
    place = lambda c: F.struct(F.col("_at")[c["a"]].alias("start"), (F.col("_at")[c["b"]] - F.col("_at")[c["a"]] + 1).alias("n_lines"))
    made = F.transform(F.transform(spans, place), lambda c: F.struct(c["start"].alias("start"), c["n_lines"].alias("n_lines"), F.unhex(F.md5(_body(c["start"], c["n_lines"]).cast("binary"))).alias("h")))
    return ended.select("_mark", F.explode(made).alias("c")).select("_mark", "c.*")


def dedup_lines(docs: DataFrame, divisor: int = 4, key: str = "doc_id") -> DataFrame:
    """docs with repeated passages of two lines or more removed from text, and n_lines, n_removed.

    A line goes if it stands in two lines in a row (blank ones aside, which go with those
    around them) that also stand, byte for byte, at an earlier place; by induction on
    places its passage stays once.

    All columns of docs stay, but for those named as the operator's own, which are replaced.
    A null text stays null (n_lines 0); an empty text is one
    empty line.  A chunk's first place is the smallest (key, md5 of text, line), a null
    key first; rows that agree in key and text count as one document and both keep what
    the document keeps.  The text of a document that loses all its lines is empty.  An
    empty table gives no rows.

    Only hashes and places are shuffled for all chunks; texts go once to where their
    spans are known (twice if docs has further columns), and repeated bodies once more.
    The first places are a table of their own, so that both sides of the joins on a chunk
    are plain shuffles, whose frequent keys adaptive execution splits.
    """
    docs = docs.drop(*OWN)
    names = docs.columns
    mark = F.struct(F.col(key).alias("k"), F.md5(F.col("text").cast("binary")).alias("m"))
    marked = _held(docs, "_mark", mark)
    place = F.struct("_mark", "start")
    chunks = chunks_of(marked.select("_mark", "text"), divisor)
    firsts = cut(chunks.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("h", "first"))
    later = chunks.join(firsts, "h").where(place > F.col("first")).select("_mark", "start", "n_lines", "h").distinct()
    # of a document's chunks those that no other holds
    before = Window.partitionBy("_mark").orderBy("start", F.col("n_lines").desc()).rowsBetween(Window.unboundedPreceding, -1)
    outer = cut(later.withColumn("_to", F.max(F.col("start") + F.col("n_lines")).over(before)).where(F.col("_to").isNull() | (F.col("start") + F.col("n_lines") > F.col("_to"))).drop("_to"))
    used = outer.groupBy("h").agg(F.max("n_lines").alias("n_lines")).join(firsts, "h").select(F.col("first._mark").alias("_mark"), F.col("first.start").alias("start"), "n_lines", "h")
    spans = outer.withColumn("is_first", F.lit(False)).unionByName(used.withColumn("is_first", F.lit(True)))
    spans = spans.groupBy(F.col("_mark").alias("_of")).agg(F.collect_list(F.struct("start", "n_lines", "h", "is_first")).alias("_spans"))
    # (the key is read from the mark, so that the texts' shuffle is one for both uses)
    rest = [c for c in names if c not in (key, "text")]
    sent = marked.select("_mark", "text", *rest)
    lined = _held(sent.select("_mark", "text").join(spans, F.col("_mark") == F.col("_of")), "_lines", F.split("text", "\n", -1))
    body = lambda c: F.struct(c["start"].alias("start"), c["n_lines"].alias("n_lines"), c["h"].alias("h"), c["is_first"].alias("is_first"), _body(c["start"], c["n_lines"]).alias("body"))
    bodies = lined.select("_mark", F.explode(F.transform("_spans", body)).alias("c")).select("_mark", "c.*")
    original = bodies.where("is_first").select("h", F.col("body").alias("_original")).dropDuplicates(["h"])
    same = bodies.where("NOT is_first").join(original, "h").where("body = _original")
    removed = same.groupBy(F.col("_mark").alias("_of")).agg(F.collect_set(F.struct("start", "n_lines")).alias("_gone"))
    joined = sent.join(removed, F.col("_mark") == F.col("_of"), "left")
    gone = F.array_distinct(F.flatten(F.transform("_gone", lambda r: F.sequence(r["start"], r["start"] + r["n_lines"] - 1))))
    numbered = _held(_held(joined, "_lines", F.split("text", "\n", -1)), "_gone", F.when(F.col("_gone").isNotNull(), gone))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone"), lambda i: F.col("_lines")[i])
    return (
        numbered.withColumn("n_lines", F.coalesce(F.when(F.col("text").isNotNull(), F.size("_lines")), F.lit(0)).cast("bigint"))
        .withColumn("n_removed", F.coalesce(F.when(F.col("_gone").isNotNull(), F.size("_gone")), F.lit(0)).cast("bigint"))
        .withColumn("text", F.when(F.col("_gone").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text")))
        .withColumn(key, F.col("_mark.k"))
        .select(*names, "n_lines", "n_removed")
    )


def dedup_sql(source: str = "documents") -> str:
    """The same as DuckDB SQL: doc_id, text, n_lines, n_removed."""
    return f"""
WITH docs AS (SELECT doc_id, md5(text) AS m, text, string_split(text, chr(10)) AS l FROM {source}),
lines AS (SELECT DISTINCT doc_id, m, unnest(generate_series(0, len(l) - 1)) AS i, unnest(l) AS line FROM docs),
pairs AS (
  SELECT doc_id, m, i, lead(i) OVER (PARTITION BY doc_id, m ORDER BY i) AS j
  FROM lines WHERE regexp_matches(line, '{FULL}')),
bodies AS (
  SELECT DISTINCT p.doc_id, p.m, p.i, p.j, array_to_string(d.l[p.i + 1:p.j + 1], chr(10)) AS body
  FROM pairs p JOIN docs d ON p.doc_id IS NOT DISTINCT FROM d.doc_id AND p.m = d.m WHERE p.j IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS FIRST, m, i) AS r FROM bodies),
gone AS (SELECT DISTINCT doc_id, m, unnest(generate_series(i, j)) AS i FROM ranked WHERE r > 1),
kept AS (
  SELECT n.doc_id, n.m, string_agg(n.line, chr(10) ORDER BY n.i) FILTER (WHERE g.i IS NULL) AS text, count(*) AS n_lines, count(g.i) AS n_removed
  FROM lines n LEFT JOIN gone g ON n.doc_id IS NOT DISTINCT FROM g.doc_id AND n.m = g.m AND n.i = g.i GROUP BY n.doc_id, n.m)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed
FROM docs d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.m = k.m"""
