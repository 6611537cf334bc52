"""Repair passes over lines. Each takes and returns (doc, line_no, line); line numbers are kept, so gaps appear where lines go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions import rules
from inkloom.functions.text import blank, group, like, literal, one_of, rewrite, strip, sub
from inkloom.operators.lines import by_line, fence_mask

BEFORE = (Window.unboundedPreceding, -1)


def _below(value: Column) -> Column:
    """The first value that is not null below a line: the last one before it in falling order, which one pass finds."""
    return F.last(value, True).over(Window.partitionBy("doc").orderBy(F.col("line_no").desc()).rowsBetween(*BEFORE))


def _changed(lines: DataFrame, value: Column) -> DataFrame:
    return lines.withColumn("line", value)


def structural(x: Column) -> Column:
    return like(x, r"^\s*(#|\||>|```|!\[)")


def strip_toc(lines: DataFrame) -> DataFrame:
    """A contents heading whose next non-blank line is a table row goes, with all rows, blanks and page numbers after it."""
    x = F.col("line")
    lines = lines.withColumn("_absorb", like(x, r"^\s*\|") | blank(x) | like(x, r"^\s*\d{1,4}\s*$"))
    lines = lines.withColumn("_g", F.sum((~F.col("_absorb")).cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("doc", "_g").orderBy("line_no")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.first(like(x, r"^\s*#{1,6}\s+(?:Table of )?Contents\s*$", "i") & ~F.col("_absorb")).over(whole)
    row = F.first(F.when(F.col("_absorb") & ~blank(x), like(x, r"^\s*\|")), ignorenulls=True).over(whole)
    return lines.withColumn("_drop", head & F.coalesce(row, F.lit(False))).where("NOT _drop").select("doc", "line_no", "line")


def strip_chunk_dividers(lines: DataFrame) -> DataFrame:
    return lines.where(strip(F.col("line")) != "---")


def strip_orphan_dashes(lines: DataFrame) -> DataFrame:
    return lines.where(strip(F.col("line")) != "-")


def strip_page_numbers(lines: DataFrame, digits: int = 4) -> DataFrame:
    """Numbers that stand alone between blanks or edges go."""
    lone = like(F.col("line"), rf"^\s*\d{{1,{digits}}}\s*$")
    beside = [blank(F.coalesce(f("line").over(by_line()), F.lit(""))) for f in (F.lag, F.lead)]
    return lines.withColumn("_drop", lone & beside[0] & beside[1]).where("NOT _drop").drop("_drop")


def consolidate_title(lines: DataFrame, doc_title: str | None = None, title: str = rules.TITLE) -> DataFrame:
    """The first line that matches becomes the title, later ones go; a given title that matches nothing is put in front."""
    hit = like(F.col("line"), title, "i")
    ranked = lines.withColumn("_hit", hit).withColumn("_n", F.sum(F.col("_hit").cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0)))
    named = F.lit(doc_title) if doc_title else strip(sub(F.col("line"), r"^#+", ""))
    out = ranked.where("NOT _hit OR _n = 1").withColumn("line", F.when(F.col("_hit"), F.concat(F.lit("# "), named)).otherwise(F.col("line")))
    out = out.select("doc", "line_no", "line")
    if not doc_title:
        return out
    bare = ranked.groupBy("doc").agg(F.max("_n").alias("n"), F.min("line_no").alias("first")).where("n = 0")
    front = bare.select("doc", F.explode(F.array(F.struct((F.col("first") - 2).alias("line_no"), F.lit("# " + doc_title).alias("line")), F.struct((F.col("first") - 1).alias("line_no"), F.lit("").alias("line")))).alias("r")).select("doc", "r.*")
    return out.unionByName(front.select("doc", F.col("line_no").cast(dict(out.dtypes)["line_no"]), "line"))


def promote_pillars(lines: DataFrame) -> DataFrame:
    name = group(F.col("line"), r"^##\s+(.+?)\s*$")
    return _changed(lines, F.when(name.isin(rules.PILLARS), F.concat(F.lit("# "), name)).otherwise(F.col("line")))


def demote_subsections(lines: DataFrame) -> DataFrame:
    x = F.col("line")
    bullet, practice, question = (group(x, p) for p in (r"^##\s+[·•]\s+(.+?)\s*$", r"^##\s+(FSI[A-Z]+\d+-BP\d+.*?)\s*$", r"^##\s+(FSI[A-Z]+\d+[A-Z]?:\s+.+?)\s*$"))
    label, name = group(x, rf"^(?:##|####)\s+({rules.LABELS})\s*$"), group(x, r"^##\s+(.+?)\s*$")
    return _changed(
        lines,
        F.when(bullet != "", F.concat(F.lit("- **"), strip(bullet), F.lit("**"))).when(practice != "", F.concat(F.lit("#### "), practice)).when(question != "", F.concat(F.lit("### "), question))
        .when(label != "", F.concat(F.lit("##### "), label)).when(name.isin(rules.SUBSECTIONS), F.concat(F.lit("### "), name)).otherwise(x),
    )


def indent_lettered(lines: DataFrame) -> DataFrame:
    return _changed(lines, sub(F.col("line"), r"^- ([a-z])\.\s+(.+)$", "  - $1. $2"))


# fixed values: patterns of numbered headings, of chapter numbers and of headings in capitals
DOTTED = r"^(#{1,6})\s+(\d{1,2})((?:\.\d+)+)\s+(\S.*?)\s*$"
CHAPTER = r"^#{1,6}\s+0*(\d{1,2})(?:\s+(\S.*?))?\s*$"
CAPITALS = r"^#{1,6}\s+([A-Z][A-Z &-]{2,})\s*$"


def number_chapters(lines: DataFrame, doc_title: str | None = None, min_sections: int = 4, min_majors: int = 2) -> DataFrame:
    """The heading hierarchy of a numbered book, rebuilt from its numbers; other documents stay as they are."""
    w = by_line()
    before = w.rowsBetween(*BEFORE)
    whole = Window.partitionBy("doc")
    x = F.col("line")
    f = fence_mask(lines)
    free = ~F.col("fenced")
    f = f.withColumn("_dot", F.when(free & like(x, DOTTED), F.struct(group(x, DOTTED, 2).cast("int").alias("major"), F.least(F.lit(6), F.length(group(x, DOTTED, 3)) - F.length(F.regexp_replace(group(x, DOTTED, 3), r"\.", "")) + 1).alias("level"), F.col("line_no").alias("at"))))
    f = f.withColumn("_caps", F.when(free & like(x, CAPITALS), strip(group(x, CAPITALS))))
    f = f.withColumn("_majors", F.collect_set("_dot.major").over(whole)).withColumn("_book", (F.count("_dot").over(whole) >= min_sections) & (F.size("_majors") >= min_majors))
    f = f.withColumn("_prev", F.last("_dot", True).over(before)).withColumn("_next", _below(F.col("_dot")))
    caps_at = F.when(F.col("_caps").isNotNull(), F.col("line_no"))
    f = f.withColumn("_caps_at", _below(caps_at))
    shown = F.when(~blank(x), F.struct(F.col("line_no").alias("at"), F.col("_caps").alias("caps")))
    f = f.withColumn("_below", _below(shown))
    head = F.col("_book") & free & x.startswith("#")
    number, tail = group(x, CHAPTER, 1).try_cast("int"), strip(group(x, CHAPTER, 2))
    chapter = head & like(x, CHAPTER) & F.coalesce(F.array_contains("_majors", number), F.lit(False))
    capital_tail = (tail == "") | ((tail == F.upper(tail)) & (tail != F.lower(tail)))
    joins = chapter & capital_tail & F.col("_below.caps").isNotNull()
    f = f.withColumn("_chapter", chapter).withColumn("_eats", F.when(joins, F.col("_below.at")))
    # a heading that a chapter number above has taken, and the blanks between, are gone
    f = f.withColumn("_eaten", F.coalesce(F.last("_eats", True).over(before) >= F.col("line_no"), F.lit(False)))
    title = strip(F.concat_ws(" ", F.when(tail != "", tail), F.when(F.col("_eats").isNotNull(), F.col("_below.caps"))))
    dotted = F.concat(F.repeat(F.lit("#"), F.col("_dot.level")), F.lit(" "), group(x, DOTTED, 2), group(x, DOTTED, 3), F.lit(" "), group(x, DOTTED, 4))
    p, n = F.col("_prev.major"), F.col("_next.major")
    later = F.coalesce(F.col("_caps_at") < F.col("_next.at"), F.lit(False))
    promoted = ~p.eqNullSafe(n) & ~(p.isNotNull() & n.isNotNull() & later)
    caps = F.when(promoted & p.isNotNull() & (n == p + 1), F.concat(F.lit("# "), n.cast("string"), F.lit(" "), F.col("_caps"))).when(promoted, F.concat(F.lit("# "), F.col("_caps"))).otherwise(x)
    inside = head & like(x, r"^(#{1,6})\s+(\S.*)$") & p.isNotNull() & (p == n)
    deeper = F.concat(F.repeat(F.lit("#"), F.least(F.col("_prev.level") + 1, F.lit(6))), F.lit(" "), group(x, r"^(#{1,6})\s+(\S.*)$", 2))
    repeated = head & ~F.col("_chapter") & F.col("_dot").isNull() & (F.lower("_caps") == F.lit((doc_title or "").strip().lower())) & F.lit(bool(doc_title))
    made = (
        F.when(F.col("_chapter"), strip(F.concat(F.lit("# "), number.cast("string"), F.lit(" "), title)))
        .when(head & F.col("_dot").isNotNull(), dotted).when(head & F.col("_caps").isNotNull(), caps).when(inside, deeper).otherwise(x)
    )
    out = f.withColumn("_made", made).withColumn("_gone", F.col("_eaten") | F.coalesce(repeated, F.lit(False)))
    return out.where("NOT _gone").select("doc", "line_no", F.col("_made").alias("line"))


def heal_list_gaps(lines: DataFrame) -> DataFrame:
    """Blanks between two items of one indent go."""
    x = F.col("line")
    item = F.when(~blank(x), F.struct(like(x, rules.LIST_ITEM).alias("is"), group(x, rules.LIST_ITEM).alias("indent")))
    f = lines.withColumn("_i", item)
    f = f.withColumn("_a", F.last("_i", True).over(by_line().rowsBetween(*BEFORE))).withColumn("_b", _below(F.col("_i")))
    gap = F.col("_i").isNull() & F.coalesce(F.col("_a.is") & F.col("_b.is") & (F.col("_a.indent") == F.col("_b.indent")), F.lit(False))
    return f.where(~gap).select("doc", "line_no", "line")


def heal_hyphens(lines: DataFrame) -> DataFrame:
    """A word and the end of it that a line break cut off are joined, unless a function word follows the hyphen."""
    kept = rf"-\s+(?:{'|'.join(rules.FUNCTION_WORDS)})$"
    return _changed(lines, rewrite(F.col("line"), r"\b[A-Za-z]+-\s+[a-z][a-z]\w*", lambda m: F.when(like(m, kept, "i"), m).otherwise(sub(m, r"-\s+", "-"))))


def heal_sentences(lines: DataFrame) -> DataFrame:
    """An unfinished line takes up the next paragraph if that begins in lower case; of a run of such joins every other holds."""
    x, w = F.col("line"), by_line()
    f = lines.withColumn("_row", F.row_number().over(w)).withColumn("_full", ~blank(x))
    f = f.withColumn("_next", _below(F.when(F.col("_full"), F.struct("_row", "line"))))
    ends = "|".join(literal(e) for e in rules.SENTENCE_ENDS)
    nxt = F.col("_next.line")
    edge = F.col("_full") & ~structural(x) & ~like(x, rf"(?:{ends})\s*$") & (F.col("_next._row") > F.col("_row") + 1)
    edge = edge & like(nxt, r"^\p{javaLowerCase}") & ~structural(nxt) & ~like(nxt, rules.LIST_ITEM)
    f = f.withColumn("_edge", F.coalesce(edge, F.lit(False)))
    # runs of edges among the non-blank rows
    f = f.withColumn("_run", F.coalesce(F.sum((F.col("_full") & ~F.col("_edge")).cast("int")).over(w.rowsBetween(*BEFORE)), F.lit(0)))
    f = f.withColumn("_place", F.sum(F.col("_edge").cast("int")).over(Window.partitionBy("doc", "_run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    f = f.withColumn("_fires", F.col("_edge") & (F.col("_place") % 2 == 1))
    f = f.withColumn("_taken", F.coalesce(F.last(F.when(F.col("_fires"), F.col("_next._row")), True).over(w.rowsBetween(*BEFORE)) >= F.col("_row"), F.lit(False)))
    joined = F.concat(sub(x, r"\s+$", ""), F.lit(" "), sub(nxt, r"^\s+", ""))
    return f.where("NOT _taken").select("doc", "line_no", F.when(F.col("_fires"), joined).otherwise(x).alias("line"))


def fix_digit_headings(lines: DataFrame, ruleset: str = "aws") -> DataFrame:
    x = F.col("line")
    kept = lines.where(~like(x, r"^#+\s+[\W_]+\s*$"))
    if ruleset != "aws":
        return kept
    head = r"^(#+)\s+(\d.*)$"
    marks, rest = group(x, head, 1), sub(strip(group(x, head, 2)), r"[:：.]+$", "")
    step = lambda p: F.concat(marks, F.lit(" Step "), group(rest, p, 1), F.lit(": "), group(rest, p, 2))
    listed, plain = r"^(\d+)[.\)]\s+(.+)$", r"^(\d+)\s+(.+)$"
    return _changed(kept, F.when(~like(x, head), x).when(like(rest, listed), step(listed)).when(like(rest, plain), step(plain)).otherwise(F.concat(marks, F.lit(" Ref. "), rest)))


def unglue_compounds(lines: DataFrame) -> DataFrame:
    x = F.col("line")
    words = F.create_map(*[F.lit(v) for kv in rules.GLUED.items() for v in kv])
    pattern = rf"(?<![/\\.])\b(?:{one_of(rules.GLUED)})\b(?![/\\.])"
    return _changed(lines, rewrite(x, pattern, lambda m: F.element_at(words, m)))


def heal_spaces(lines: DataFrame) -> DataFrame:
    words = F.create_map(*[F.lit(v) for kv in rules.SPACE_FIXES.items() for v in kv])
    return _changed(lines, rewrite(F.col("line"), rf"\b(?:{one_of(rules.SPACE_FIXES)})\b", lambda m: F.element_at(words, m)))


def strip_emphasis_space(lines: DataFrame) -> DataFrame:
    """Padding inside a strong run goes; runs of white space alone stay."""
    return _changed(lines, rewrite(F.col("line"), r"(\*\*|__)[^\n]+?\1", lambda m: sub(m, r"^(\*\*|__)\s*(\S.*\S|\S)\s*\1$", "$1$2$1", "s")))


def space_adjacency(lines: DataFrame) -> DataFrame:
    x = F.col("line")
    for pattern, by in rules.ADJACENCY:
        x = sub(x, pattern, by)
    return _changed(lines, x)


def _unfenced(lines: DataFrame, value: Column) -> DataFrame:
    return fence_mask(lines).withColumn("line", F.when(F.col("fenced"), F.col("line")).otherwise(value)).drop("fenced")


def strip_image_alt(lines: DataFrame) -> DataFrame:
    return _unfenced(lines, sub(F.col("line"), r"!\[\s*image\s*\](?=\()", "![]", "i"))


def absolute_links(lines: DataFrame, base: str = rules.REL_BASE) -> DataFrame:
    def change(m: Column) -> Column:
        href = F.replace(group(m, r"\]\(([^)\s]+)\)$"), F.lit("\\"), F.lit("/"))
        whole = href.contains("://") | like(href, r"^(mailto:|tel:|#|/)")
        target = F.when(whole, href).otherwise(F.concat(F.lit(base), sub(href, r"^(?:\./)+", "")))
        return F.concat(sub(m, r"\]\([^)\s]+\)$", ""), F.lit("]("), target, F.lit(")"))

    return _changed(lines, rewrite(F.col("line"), rules.LINK, change))


def corpus_fixes(lines: DataFrame, ruleset: str = "aws") -> DataFrame:
    return _changed(lines, sub(F.col("line"), r"\bWellArchitected\b", "Well-Architected")) if ruleset == "aws" else lines


def wrap_aligned(lines: DataFrame) -> DataFrame:
    def change(m: Column) -> Column:
        body = group(m, r"^\$\$(.+?)\$\$$")
        bare = (body.contains("&") | body.contains("\\\\")) & ~body.contains("\\begin{")
        return F.when(bare, F.concat(F.lit("$$\\begin{aligned}"), body, F.lit("\\end{aligned}$$"))).otherwise(m)

    return _unfenced(lines, rewrite(F.col("line"), r"\$\$(?:.+?)\$\$", change))


def escape_dollars(lines: DataFrame) -> DataFrame:
    return _unfenced(lines, rewrite(F.col("line"), r"\$\$.*?\$\$|`+[^`]*`+|(?<!\\)\$", lambda m: F.when(m == "$", F.lit("\\$")).otherwise(m)))


def passes(ruleset: str = "aws", doc_title: str | None = None, math: bool = False) -> list:
    """The repair passes in their order."""
    aws = ruleset == "aws"
    out = [strip_toc, strip_chunk_dividers, strip_orphan_dashes, strip_page_numbers, lambda x: consolidate_title(x, doc_title)]
    out += [promote_pillars, demote_subsections, indent_lettered] if aws else [lambda x: number_chapters(x, doc_title)]
    out += [heal_list_gaps, heal_hyphens, heal_sentences, lambda x: fix_digit_headings(x, ruleset), unglue_compounds, heal_spaces, strip_emphasis_space, space_adjacency, strip_emphasis_space, strip_image_alt, absolute_links]
    out += [lambda x: corpus_fixes(x, ruleset)] + ([wrap_aligned, escape_dollars] if math else [])
    return out


def tidy(lines: DataFrame, ruleset: str = "aws", doc_title: str | None = None, math: bool = False) -> DataFrame:
    """All passes; they share one partitioning by document and one order, so there is one shuffle."""
    for step in passes(ruleset, doc_title, math):
        lines = step(lines)
    return lines
