"""Documents as ordered lines: (doc, line_no, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions import rules
from inkloom.functions.text import LINE_ENDS, like


def by_line(doc: str = "doc"):
    return Window.partitionBy(doc).orderBy("line_no")


def split_lines(text: Column) -> Column:
    """Lines of a text; a last line end closes a line and begins none."""
    body = F.regexp_replace(text, f"(?:{LINE_ENDS})\\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_ENDS, -1))


def to_lines(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc).alias("doc"), F.posexplode(split_lines(F.col(text))).alias("line_no", "line"))


def to_text(lines: DataFrame, end: str = "\n") -> DataFrame:
    """(doc, text): lines joined in order, with a line end after the last."""
    joined = F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY line_no)")
    return lines.groupBy("doc").agg(F.concat(joined, F.lit(end)).alias("text"))


def markers_before(marker: Column) -> Column:
    return F.coalesce(F.sum(marker.cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def fence_mask(lines: DataFrame, name: str = "fenced") -> DataFrame:
    """Lines of fenced blocks, their markers included."""
    marker = like(F.col("line"), rules.FENCE)
    return lines.withColumn(name, marker | (markers_before(marker) % 2 == 1))


def fence_state(lines: DataFrame, name: str = "in_fence") -> DataFrame:
    """Whether a block is open before each line: false for its first marker, true for its last."""
    return lines.withColumn(name, markers_before(like(F.col("line"), r"^\s*(```+|~~~+)")) % 2 == 1)


def tick_fence_state(lines: DataFrame, name: str = "in_fence") -> DataFrame:
    """The same for blocks of backticks only."""
    return lines.withColumn(name, markers_before(like(F.col("line"), r"^\s*```")) % 2 == 1)
