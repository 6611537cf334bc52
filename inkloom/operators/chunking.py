"""Cutting documents at headings, packing slices by size, and heading ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions import rules
from inkloom.functions.markdown import to_xhtml
from inkloom.functions.text import all_matches, group, like, rewrite, strip, sub
from inkloom.operators.lines import by_line, fence_state, markers_before

FENCE_LINE = r"^\s*(```+|~~~+)"
HEADING = r"^(#{1,6}) +(.+?)\s*$"
ATTR = r"\s+\{#([A-Za-z][\w.:-]*)\}\s*$"


def _free(lines: DataFrame) -> DataFrame:
    marker = like(F.col("line"), FENCE_LINE)
    return lines.withColumn("_free", ~marker & (markers_before(marker) % 2 == 0))


def heading_offsets(lines: DataFrame, level: int = 1) -> DataFrame:
    """(doc, line_no, start): character offsets of the headings of a level outside blocks, each line counted with its end."""
    f = _free(lines).withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(by_line().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return f.where(F.col("_free") & like(F.col("line"), "^" + "#" * level + " (?!#)")).select("doc", "line_no", "start")


def slices(lines: DataFrame) -> DataFrame:
    """(doc, chapter, section, bytes, text): lines cut before each H1, and within that before each H2; both begin at 0."""
    f = _free(lines)
    w = by_line().rowsBetween(Window.unboundedPreceding, 0)
    h = [F.col("_free") & like(F.col("line"), "^" + "#" * k + " (?!#)") for k in (1, 2)]
    f = f.withColumn("chapter", F.sum(h[0].cast("int")).over(w)).withColumn("_h2", h[1])
    f = f.withColumn("section", F.sum(F.col("_h2").cast("int")).over(Window.partitionBy("doc", "chapter").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    text = F.expr("listagg(line || '\\n', '') WITHIN GROUP (ORDER BY line_no)")
    return f.groupBy("doc", "chapter", "section").agg(text.alias("text")).withColumn("bytes", F.octet_length("text"))


def split_h1(lines: DataFrame) -> DataFrame:
    """(doc, chapter, bytes, text), the text before the first H1 as chapter 0."""
    s = slices(lines)
    return s.groupBy("doc", "chapter").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY section)").alias("text")).withColumn("bytes", F.octet_length("text"))


def pack_sections(lines: DataFrame, most: int = 200 * 1024) -> DataFrame:
    """(doc, chapter, part, bytes, text): chapters over `most` bytes are cut at H2, and neighbours put together while they fit; blank parts go."""
    s = slices(lines)
    per = s.groupBy("doc", "chapter").agg(F.sort_array(F.collect_list(F.struct("section", "bytes"))).alias("xs"), F.sum("bytes").alias("total"))
    # fold: part number of each section, and what the open part holds
    zero = F.struct(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("held"), F.array().cast("array<int>").alias("parts"))

    def step(acc: Column, x: Column) -> Column:
        over = (acc["held"] > 0) & (acc["held"] + x["bytes"] > most)
        part = F.when(over, acc["part"] + 1).otherwise(acc["part"])
        held = F.when(over, x["bytes"].cast("bigint")).otherwise(acc["held"] + x["bytes"])
        return F.struct(part.alias("part"), held.alias("held"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    parts = F.when(F.col("total") <= most, F.transform("xs", lambda _: F.lit(0))).otherwise(F.aggregate("xs", zero, step)["parts"])
    placed = per.select("doc", "chapter", F.explode(F.arrays_zip(F.col("xs.section").alias("section"), parts.alias("part"))).alias("z")).select("doc", "chapter", F.col("z.section").alias("section"), F.col("z.part").alias("part"))
    text = F.expr("listagg(text, '') WITHIN GROUP (ORDER BY section)")
    out = s.join(placed, ["doc", "chapter", "section"]).groupBy("doc", "chapter", "part").agg(text.alias("text"))
    return out.where(~like(F.col("text"), r"^\s*$")).withColumn("bytes", F.octet_length("text"))


def heading_ids(lines: DataFrame) -> DataFrame:
    """(doc, line_no, line, ord, id): lines without id suffixes; headings have their ordinal and their id, if any."""
    f = fence_state(lines)
    head = ~F.col("in_fence") & like(F.col("line"), HEADING)
    f = f.withColumn("_head", head).withColumn("ord", F.when(head, F.sum(head.cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0))))
    return f.select("doc", "line_no", F.when(F.col("_head"), sub(F.col("line"), ATTR, "")).otherwise(F.col("line")).alias("line"), F.col("ord").cast("int").alias("ord"), F.when(F.col("_head"), F.nullif(group(F.col("line"), ATTR), F.lit(""))).alias("id"))


def attach_ids(rendered: DataFrame, ids: DataFrame) -> DataFrame:
    """Rendered headings (doc, ord, level, text) with the ids of the same ordinal: a positional join."""
    return rendered.join(ids.where("ord IS NOT NULL").select("doc", "ord", "id"), ["doc", "ord"], "left")


def first_heading(lines: DataFrame, default: str = "Chapter") -> DataFrame:
    """(doc, title): the first heading outside blocks."""
    f = fence_state(lines)
    text = F.when(~F.col("in_fence") & like(F.col("line"), HEADING), strip(sub(group(F.col("line"), HEADING, 2), ATTR, "")))
    return f.groupBy("doc").agg(F.coalesce(F.min_by(text, F.when(text.isNotNull(), F.col("line_no"))), F.lit(default)).alias("title"))


def image_sources(pages: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(src, media): local images that pages (html) name; with `existing` (src), only those that exist (semi-join)."""
    found = pages.select(F.explode(all_matches(F.col("html"), r"<img[^>]*\bsrc=\"([^\"]+)\"", 1, "i")).alias("src")).where(~F.col("src").rlike("^(https?://|data:|/)")).distinct()
    if existing is not None:
        found = found.join(existing.select("src"), "src", "left_semi")
    media = F.create_map(*[F.lit(x) for kv in rules.MEDIA.items() for x in kv])
    return found.withColumn("media", F.coalesce(F.element_at(media, F.lower(F.regexp_extract("src", r"\.([A-Za-z0-9]+)$", 1))), F.lit("application/octet-stream")))


def unique_ids(ids: DataFrame) -> DataFrame:
    """(book, member, id, new_id): an id that several files have stays in the first of them; others get the first free suffix.

    Taken names are those of the book as it is, and suffixes already given to the same id.
    """
    seen = ids.select("book", "member", "id").distinct()
    ranked = seen.withColumn("k", F.row_number().over(Window.partitionBy("book", "id").orderBy("member")) - 1)
    again = ranked.where("k > 0")
    per = again.groupBy("book", "id").agg(F.max("k").alias("n"))
    taken = seen.select("book", F.col("id").alias("name")).distinct()
    clash = per.join(taken.withColumn("base", F.regexp_replace("name", r"-\d+$", "")).withColumn("number", F.regexp_extract("name", r"-(\d{1,9})$", 1).try_cast("int")).where("number IS NOT NULL").select("book", F.col("base").alias("id"), "number"), ["book", "id"], "left")
    used = clash.groupBy("book", "id").agg(F.max("n").alias("n"), F.collect_set("number").alias("used"))
    free = used.withColumn("free", F.array_sort(F.array_except(F.sequence(F.lit(1), F.col("n").cast("int") + F.size("used")), "used")))
    named = again.join(free.select("book", "id", "free"), ["book", "id"]).withColumn("new_id", F.concat("id", F.lit("-"), F.col("free")[F.col("k") - 1].cast("string")))
    return ranked.join(named.select("book", "member", "id", "new_id"), ["book", "member", "id"], "left").select("book", "member", "id", F.coalesce("new_id", "id").alias("new_id"))


def nth_ids(ids: DataFrame) -> DataFrame:
    """(book, ord, id, new_id): the n-th repeat of an id in reading order gets the suffix -(n-1)."""
    k = F.row_number().over(Window.partitionBy("book", "id").orderBy("ord")) - 1
    return ids.withColumn("new_id", F.when(k > 0, F.concat("id", F.lit("-"), k.cast("string"))).otherwise(F.col("id")))


def rewrite_hrefs(hrefs: DataFrame, renamed: DataFrame) -> DataFrame:
    """Links whose target (file name, id) was renamed follow it; of two files of one name the first holds."""
    name = F.regexp_replace("member", "^.*/", "")
    moved = renamed.where("id <> new_id").groupBy("book", name.alias("file"), "id").agg(F.min_by("new_id", "member").alias("new_id"))
    file = F.regexp_replace(F.regexp_extract("href", "^([^#]*)#", 1), "^.*/", "")
    h = hrefs.withColumn("id", F.regexp_extract("href", "#(.*)$", 1)).withColumn("file", F.when(file == "", name).otherwise(file))
    out = h.join(moved, ["book", "file", "id"], "left")
    return out.select("book", "member", "line", F.when(F.col("new_id").isNotNull(), F.concat(F.regexp_extract("href", "^([^#]*#)", 1), F.col("new_id"))).otherwise(F.col("href")).alias("href"))


def safe_dirname(stem: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.lit("doc")), F.lit("_artifacts"))


def page_ranges(docs: DataFrame, size: int = 20) -> DataFrame:
    """(doc, start, end) of runs of `size` pages of documents (doc, total)."""
    starts = docs.where("total > 0").select("doc", "total", F.explode(F.sequence(F.lit(0), F.col("total").cast("int") - 1, F.lit(size))).alias("start"))
    return starts.select("doc", "start", F.least(F.col("start") + size, F.col("total").cast("int")).alias("end"))


def merge_parts(parts: DataFrame) -> DataFrame:
    """(doc, text): parts (doc, part, text) in order, a blank line between; a failed part (null text) leaves a comment."""
    text = F.coalesce("text", F.concat(F.lit("<!-- chunk "), F.col("part").cast("string"), F.lit(" failed -->")))
    return parts.withColumn("text", text).groupBy("doc").agg(F.expr("listagg(text, '\\n\\n') WITHIN GROUP (ORDER BY part)").alias("text"))


def build_name(stem: Column) -> Column:
    """The name of a document's build folder: separators become underscores; null where nothing but dots is left."""
    name = strip(F.translate(stem, "/\\", "__"))
    return F.when(~name.isin("", ".", ".."), name)


#: Targets of links and images, and (fixed value) absolute paths of extracted images.
IMAGE_PATH = r"(?i:(?:[A-Za-z]:[\\/]|/)[^)\r\n]*?image_[0-9]+_[0-9a-f]+\.png)|(?<=\]\()[^)\s]+(?=\))"


def absorb_images(lines: DataFrame, images: DataFrame, folder: str = "doc_artifacts") -> DataFrame:
    """Each path whose file name is among the images (doc, name) points into the folder, prefixed by the document's number."""
    name = lambda m: F.regexp_replace(F.replace(m, F.lit("\\"), F.lit("/")), "^.*/", "")
    named = lines.select("doc", "line_no", F.explode(F.array_distinct(F.transform(all_matches(F.col("line"), IMAGE_PATH), name))).alias("name"))
    known = named.join(images.select("doc", "name").distinct(), ["doc", "name"], "left_semi").groupBy("doc", "line_no").agg(F.collect_set("name").alias("_names"))
    place = lambda m: F.concat(F.lit(folder + "/"), F.format_string("c%04d_", F.col("doc").cast("int")), name(m))
    moved = rewrite(F.col("line"), IMAGE_PATH, lambda m: F.when(F.array_contains("_names", name(m)), place(m)).otherwise(m))
    return lines.join(known, ["doc", "line_no"], "left").select("doc", "line_no", F.when(F.col("_names").isNotNull(), moved).otherwise(F.col("line")).alias("line"))


def render(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with `xhtml`: the markdown column as the body of a page.  A document's text is rendered whole; null gives an empty body."""

    @F.pandas_udf("string")
    def rendered(x: pd.Series) -> pd.Series:
        return x.map(to_xhtml, na_action=None)

    return texts.withColumn("xhtml", rendered(F.col(text)))
