"""Display formulas: harvest from layout trees, pixel boxes, and alignment with the text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.text import all_matches, pieces, strip
from inkloom.operators.lines import fence_mask

SEGMENT = r"`+[^`]*`+|\$\$.+?\$\$"


def harvest(nodes: DataFrame, depth: int = 64) -> DataFrame:
    """(doc, ord, node, page_no, ...) of formulas in reading order.

    nodes: doc, node, parent (null under the body), pos (place among its siblings), label,
    text, page_no, has_box.  The tree is walked level by level, by one join for each, which
    carry every node's path; a tree of more than `depth` levels is an error.  Formulas
    without text or box are left out.
    """
    level = nodes.where("parent IS NULL").select("doc", "node", F.array("pos").alias("path"))
    levels = [level]
    while not level.isEmpty():
        if len(levels) > depth:
            raise ValueError(f"a layout tree has more than {depth} levels")
        above = level.select("doc", F.col("node").alias("parent"), F.col("path").alias("_above"))
        level = nodes.join(above, ["doc", "parent"]).select("doc", "node", F.concat("_above", F.array("pos")).alias("path"))
        levels.append(level)
    tree = reduce(DataFrame.unionByName, levels[:-1] or levels)
    found = nodes.join(tree, ["doc", "node"]).where((F.col("label") == "formula") & F.col("has_box") & (strip(F.coalesce("text", F.lit(""))) != ""))
    return found.withColumn("ord", F.row_number().over(Window.partitionBy("doc").orderBy("path")) - 1).select("doc", "ord", "node", "page_no", "text")


def pixel_box(boxes: DataFrame, pad_x: float = 0.05, pad_y: float = 0.12) -> DataFrame:
    """left, top, right, bottom in pixels of boxes (l, t, r, b, origin, page_w, page_h, img_w, img_h): padded, rounded half to even, kept within the image."""
    c = F.col
    y = lambda v: F.when(c("origin") == "BOTTOMLEFT", (c("page_h") - c(v)) / c("page_h")).otherwise(c(v) / c("page_h"))
    f = boxes.withColumns({"_t": F.least(y("t"), y("b")), "_b": F.greatest(y("t"), y("b")), "_l": F.least(c("l") / c("page_w"), c("r") / c("page_w")), "_r": F.greatest(c("l") / c("page_w"), c("r") / c("page_w"))})
    f = f.withColumns({"_w": (c("_r") - c("_l")) * pad_x, "_h": (c("_b") - c("_t")) * pad_y})
    kept = lambda v, most: F.least(c(most).cast("int"), F.greatest(F.lit(0), F.rint(v).cast("int")))
    out = {"left": kept((c("_l") - c("_w")) * c("img_w"), "img_w"), "top": kept((c("_t") - c("_h")) * c("img_h"), "img_h"), "right": kept((c("_r") + c("_w")) * c("img_w"), "img_w"), "bottom": kept((c("_b") + c("_h")) * c("img_h"), "img_h")}
    return f.withColumns(out).drop("_t", "_b", "_l", "_r", "_w", "_h")


def segments(lines: DataFrame) -> DataFrame:
    """(doc, line_no, pos, ord, body) of display formulas outside blocks and code spans, numbered through the document."""
    found = fence_mask(lines).where("NOT fenced").where(F.col("line").contains("$$")).select("doc", "line_no", F.posexplode(all_matches(F.col("line"), SEGMENT)).alias("pos", "m")).where(F.col("m").startswith("$$"))
    return found.select("doc", "line_no", "pos", (F.row_number().over(Window.partitionBy("doc").orderBy("line_no", "pos")) - 1).alias("ord"), F.expr("substr(m, 3, length(m) - 4)").alias("body"))


def renders(body: Column) -> Column:
    """Whether a formula is taken to render: braces balance, and separators stand in an environment."""
    count = lambda s: F.length(body) - F.length(F.replace(body, F.lit(s), F.lit("")))
    return (count("{") == count("}")) & ~((body.contains("&") | body.contains("\\\\")) & ~body.contains("\\begin{"))


def image_fallback(lines: DataFrame, boxes: DataFrame, can_render=renders, prefix: str = "formula", folder: str = "media") -> DataFrame:
    """(doc, line_no, line): formulas that do not render become references to the crop of the box of the same ordinal.

    boxes: doc, ord, page_w, page_h and the edges in pixels.  Formulas without a box, or
    with one without area, stay.
    """
    seg = segments(lines)
    judged = seg.select("body").distinct().withColumn("ok", can_render(F.col("body")))
    usable = boxes.where("page_w > 0 AND page_h > 0 AND right > left AND bottom > top").select("doc", "ord", F.lit(True).alias("boxed"))
    swap = seg.join(judged, "body").where("NOT ok").join(usable, ["doc", "ord"], "left_semi")
    per_line = swap.groupBy("doc", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.format_string(f"![]({folder}/{prefix}_%04d.png)", "ord")))).alias("by_pos"))
    f = lines.join(per_line, ["doc", "line_no"], "left")
    made = F.array_join(F.transform(pieces(F.col("line"), SEGMENT), lambda p, i: F.when(i % 2 == 1, F.coalesce(F.element_at("by_pos", F.floor((i - 1) / 2).cast("int")), p)).otherwise(p)), "")
    return f.select("doc", "line_no", F.when(F.col("by_pos").isNotNull(), made).otherwise(F.col("line")).alias("line"))


BOX = "struct<page_no: int, bbox: struct<l: double, t: double, r: double, b: double>, coord_origin: string, page_w: double, page_h: double, orig: string>"


def read_boxes(sidecars: DataFrame, key: str = "doc", text: str = "json") -> DataFrame:
    """(key, ord, page_no, l, t, r, b, origin, page_w, page_h, text) of sidecars, each a JSON array of formula boxes; what is no such array has none."""
    boxes = sidecars.select(key, F.posexplode(F.from_json(text, f"array<{BOX}>")).alias("ord", "x"))
    return boxes.select(key, "ord", "x.page_no", "x.bbox.*", F.col("x.coord_origin").alias("origin"), "x.page_w", "x.page_h", F.col("x.orig").alias("text"))
