"""Reports over findings and reviews, and the texts of package files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions import rules


def _place() -> Column:
    return F.concat(F.coalesce("file", F.lit("?")), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")))


def text_lines(findings: DataFrame) -> DataFrame:
    """(detector, file, line, report): a finding's lines of the text report."""
    head = F.concat(F.lit("["), F.rpad(F.upper("severity"), 5, " "), F.lit("] "), F.col("detector"), F.lit(" @ "), _place(), F.lit(" — "), F.col("message"))
    snippet = F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit("\n    | "), F.regexp_replace("snippet", "\n", "\n    | "))).otherwise("")
    return findings.select("detector", "file", "line", F.concat(head, snippet).alias("report"))


def json_rows(findings: DataFrame) -> DataFrame:
    """One JSON array of all findings for each file."""
    row = F.struct("detector", "severity", "file", "line", "message", "snippet", "extra")
    return findings.groupBy("file").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("json"))


def totals(findings: DataFrame) -> DataFrame:
    """(detector, severity totals): the heads of the markdown report's sections."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warn", "info")]
    return findings.groupBy("detector").agg(F.count("*").alias("n"), *counts).withColumn("heading", F.concat(F.lit("## `"), F.col("detector"), F.lit("` — "), F.col("n").cast("string"), F.lit(" finding(s)")))


def catalogue(spark) -> DataFrame:
    """All detectors in their order."""
    rows = [(i, n, k, d, f"  - {n}: {d}") for i, (n, k, d) in enumerate(rules.DETECTORS)]
    return spark.createDataFrame(rows, "ord int, detector string, kind string, description string, entry string")


def escaped(x: Column) -> Column:
    out = x
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def xhtml_page(body: Column, title: Column, lang: Column) -> Column:
    """A page around a body; the title loses its tags, is cut to 120 characters and escaped."""
    bare = F.substring(F.regexp_replace(F.regexp_replace(title, "<[^>]+>", ""), r"(?U)^\s+|\s+$", ""), 1, 120)
    name = escaped(F.coalesce(F.nullif(bare, F.lit("")), F.lit("Chapter")))
    return F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="'), lang, F.lit('">\n  <head>\n    <meta charset="utf-8"/>\n    <title>'), name,
        F.lit('</title>\n    <link rel="stylesheet" type="text/css" href="epub.css"/>\n  </head>\n  <body>\n'), body, F.lit("\n  </body>\n</html>\n"),
    )


def _parts(x: Column, by: str) -> Column:
    return F.filter(F.transform(F.split(x, by, -1), lambda p: F.trim(p)), lambda p: p != "")


def opf_metadata(title: Column, authors: Column, language: Column, publisher: Column, tags: Column, producer: Column, identifier: Column) -> Column:
    """The metadata lines of a package file."""
    tag = lambda name, x: F.concat(F.lit(f"<dc:{name}>"), escaped(x), F.lit(f"</dc:{name}>"))
    lines = F.concat(
        F.array(F.concat(F.lit('<dc:identifier id="bookid">'), identifier, F.lit("</dc:identifier>")), tag("title", F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled"))), tag("language", language)),
        F.coalesce(F.transform(_parts(authors, "&"), lambda a: tag("creator", a)), F.array().cast("array<string>")),
        F.when(F.coalesce(publisher, F.lit("")) != "", F.array(tag("publisher", publisher))).otherwise(F.array().cast("array<string>")),
        F.coalesce(F.transform(_parts(tags, ","), lambda t: tag("subject", t)), F.array().cast("array<string>")),
        F.array(tag("contributor", producer), F.lit('<meta property="dcterms:modified">1970-01-01T00:00:00Z</meta>')),
    )
    return F.array_join(lines, "\n    ")


def quoted(x: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), x, F.lit('"'))


def metadata_yaml(title: Column, authors: Column, language: Column, publisher: Column, tags: Column, producer: Column) -> Column:
    """A YAML block of metadata; several authors become a list."""
    names = _parts(F.replace(F.replace(authors, F.lit(" & "), F.lit(",")), F.lit(" and "), F.lit(",")), ",")
    several = F.concat(F.lit("creator:\n"), F.array_join(F.transform(names, lambda a: F.concat(F.lit("  - role: author\n    text: "), quoted(a))), "\n"))
    given = lambda x: F.coalesce(x, F.lit("")) != ""
    one = F.concat(F.lit("author: "), quoted(F.coalesce(F.get(names, F.lit(0)), authors)))
    subjects = _parts(tags, ",")
    lines = [
        F.lit("---"), F.when(given(title), F.concat(F.lit("title: "), quoted(title))), F.when(given(authors), F.when(F.size(names) > 1, several).otherwise(one)),
        F.concat(F.lit("lang: "), quoted(language)), F.when(given(publisher), F.concat(F.lit("publisher: "), quoted(publisher))),
        F.when(given(tags) & (F.size(subjects) > 0), F.concat(F.lit("subject:\n"), F.array_join(F.transform(subjects, lambda t: F.concat(F.lit("  - "), quoted(t))), "\n"))),
        F.when(given(producer), F.concat(F.lit("contributor:\n  - role: bkp\n    text: "), quoted(producer))), F.lit("---\n"),
    ]
    return F.concat_ws("\n", *lines)


def hexagon(cx: Column, cy: Column, r: Column, turn: Column) -> Column:
    """The six corners (x, y) of a hexagon, turned by degrees."""
    corner = lambda i: F.radians(i * 60 + turn)
    return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct((cx + r * F.cos(corner(i))).alias("x"), (cy + r * F.sin(corner(i))).alias("y")))


def gradient(y: Column, height: Column, top: Column, bottom: Column) -> Column:
    """The colour of a row of a cover, between two colours (arrays of three)."""
    share = y / height
    return F.zip_with(top, bottom, lambda a, b: F.floor(a * (1 - share) + b * share).cast("int"))


def centred(width: Column, text_width: Column) -> Column:
    """Where a text of a width begins to stand in the middle."""
    return F.floor((width - text_width) / 2).cast("int")
