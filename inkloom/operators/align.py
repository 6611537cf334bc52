"""Sampled pages, their anchor phrases, where these stand in a book, and what a reviewer answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.text import like, strip
from inkloom.operators.links import norm_text

LEAST, MOST = 8, 12


def evenly_spaced(total: Column, n: int) -> Column:
    """n indices of 0 .. total - 1 with both ends, those between rounded half to even."""
    if n <= 0:
        return F.array().cast("array<int>")
    all_of = F.sequence(F.lit(0), F.greatest(total.cast("int") - 1, F.lit(0)))
    if n == 1:
        some = F.array(F.lit(0))
    else:
        some = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * ((total - 1) / F.lit(float(n - 1)))).cast("int"))))
    return F.when(total <= 0, F.array().cast("array<int>")).when(F.lit(n) >= total, all_of).otherwise(some)


def pick_anchor(text: Column) -> Column:
    """A phrase of 8 to 12 words: of the first line of 8 words or more, unless short lines before it make up 12."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: strip(x)), lambda x: (x != "") & ~like(x, r"^\s*(?:\d{1,4}|[A-Z][.)]|\W)\s*$"))
    words = F.transform(lines, lambda x: F.split(x, r"\s+", -1))
    zero = F.struct(F.array().cast("array<string>").alias("held"), F.lit(False).alias("done"))

    def step(acc: Column, w: Column) -> Column:
        long = F.size(w) >= LEAST
        joined = F.slice(F.concat(acc["held"], w), 1, MOST)
        return F.when(acc["done"], acc).when(long, F.struct(F.slice(w, 1, MOST).alias("held"), F.lit(True).alias("done"))).otherwise(F.struct(joined.alias("held"), (F.size(joined) >= MOST).alias("done")))

    held = F.aggregate(words, zero, step)["held"]
    return F.when(F.size(held) >= LEAST, F.array_join(held, " ")).otherwise("")


#: Blocks of 32768 bits in a map of hashes: 2^27 bits, 16 MB.
BITMAPS = 4096


def among(keys: DataFrame, *names: str) -> Column:
    """Whether a row's hash of the named columns is one of those of keys, for columns of another table: true for all that are, and for few others."""
    bit = F.pmod(F.xxhash64(*names), F.lit(BITMAPS * 32768))
    rows = keys.select(bit.alias("bit")).unionByName(keys.sparkSession.range(BITMAPS).select((F.col("id") * 32768).alias("start")).select(F.lit(None).cast("bigint").alias("bit"), "start"), allowMissingColumns=True)
    marked = rows.groupBy(F.shiftright(F.coalesce("bit", "start"), 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    whole = marked.agg(F.expr("listagg(bits) WITHIN GROUP (ORDER BY part)")).scalar()
    byte = F.conv(F.hex(F.substring(whole, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


def locate(anchors: DataFrame, blocks: DataFrame, context: int = 2) -> DataFrame:
    """(book, page_no, member, para_start, para_end): the first member, then the longest beginning of the anchor, then the first block that has it.

    anchors: book, page_no, anchor; blocks: book, member, block, text.  A beginning of
    eight words or more can only stand in a block that has its first eight words: blocks
    are found by an equi-join on runs of eight words, then each length is tried.  Of the
    runs of all blocks only those are sent whose hash an anchor has (`among`), equal
    blocks and equal anchors of a book once.
    """
    words = lambda x: F.split(norm_text(x), " ", -1)
    # (no filter on anchors, and none that Spark could infer: it would be pushed down to the texts and read them once more; an empty anchor has the key '', which no block has)
    a = anchors.select("book", "page_no", F.coalesce("anchor", F.lit("")).alias("anchor"))
    asked = a.select("book", "anchor").distinct().withColumn("_w", words(F.col("anchor"))).withColumn("key", F.coalesce(F.array_join(F.slice("_w", 2, LEAST - 2), " "), F.lit("")))
    b = blocks.withColumn("_n", norm_text(F.col("text"))).withColumn("_b", F.split("_n", " ", -1))
    # the inner words of the first eight are whole words of the block; the outer two may be parts of longer ones
    keys = b.where(F.size("_b") >= LEAST).select("book", "member", "block", "_n", F.explode_outer(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_b") - LEAST + 1), lambda i: F.array_join(F.slice("_b", i + 1, LEAST - 2), " ")))).alias("key"))
    likely = keys.where(among(asked, "book", "key")).groupBy("book", "key", "_n").agg(F.min(F.struct("member", "block")).alias("at"))
    met = asked.join(likely, ["book", "key"])
    cuts = F.transform(F.sequence(F.size("_w"), F.lit(LEAST), F.lit(-1)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("_w", 1, n), " ").alias("t")))
    met = met.withColumn("cut", F.array_max(F.transform(F.filter(cuts, lambda c: F.col("_n").contains(c["t"])), lambda c: c["n"]))).where("cut IS NOT NULL")
    best = met.groupBy("book", "anchor").agg(F.min(F.struct("at.member", (-F.col("cut")).alias("c"), "at.block")).alias("m"))
    best = a.join(best, ["book", "anchor"]).groupBy("book", "page_no").agg(F.min("m").alias("m"))
    size = blocks.groupBy("book", "member").agg(F.count("*").alias("n"))
    found = best.select("book", "page_no", F.col("m.member").alias("member"), F.col("m.block").alias("block")).join(size, ["book", "member"])
    return found.select("book", "page_no", "member", F.greatest(F.lit(0), F.col("block") - context).cast("int").alias("para_start"), F.least(F.col("n"), F.col("block") + context + 1).cast("int").alias("para_end"))


def sample(pages: DataFrame, blocks: DataFrame, n: int = 5) -> DataFrame:
    """n pages of each book with their anchors and places; pages without a place stay, with '' and an empty range."""
    total = pages.groupBy("book").agg(F.max("page_no").alias("top"))
    chosen = total.select("book", F.explode(evenly_spaced(F.col("top") + 1, n)).alias("page_no"))
    anchored = pages.join(chosen, ["book", "page_no"]).select("book", "page_no", pick_anchor(F.col("text")).alias("anchor"))
    at = locate(anchored, blocks)
    out = anchored.join(at, ["book", "page_no"], "left")
    return out.select("book", "page_no", "anchor", F.coalesce("member", F.lit("")).alias("member"), F.coalesce("para_start", F.lit(0)).alias("para_start"), F.coalesce("para_end", F.lit(0)).alias("para_end"))


def build_request(chunks: DataFrame, model: str, prompt: str) -> DataFrame:
    """(book, page_no, request): the review request of a chunk as JSON."""
    block = lambda x: F.struct(F.lit("text").alias("type"), x.alias("text"))
    place = F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit(" member "), F.col("member"))
    message = F.struct(F.lit("user").alias("role"), F.array(block(F.lit(prompt)), block(place)).alias("content"))
    return chunks.select("book", "page_no", F.to_json(F.struct(F.lit(model).alias("model"), F.lit(1024).alias("max_tokens"), F.array(message).alias("messages"))).alias("request"))


def parse_reply(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """(chunk, severity, type, description) of the findings in replies; fences and prose before the JSON are taken off, and what is no JSON gives one note."""
    text = strip(F.col(reply))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    body = F.when(text.rlike(r"(?s)```(?:json)?\s*(.*?)\s*```"), fenced).otherwise(text)
    body = F.regexp_replace(body, r"(?s)^[^{]+(?=\{)", "")
    f = replies.withColumn("_t", text).where("_t <> ''").withColumn("_b", body)
    parsed = F.try_parse_json("_b")
    items = F.try_variant_get(parsed, "$.findings", "array<variant>")
    f = f.withColumn("_v", parsed).withColumn("_i", F.coalesce(items, F.array().cast("array<variant>")))
    some = f.where("_v IS NOT NULL").select("chunk", F.explode("_i").alias("x")).where(F.schema_of_variant("x").startswith("OBJECT"))
    get = lambda k, d: F.coalesce(F.try_variant_get("x", f"$.{k}", "string"), F.lit(d)).alias(k)
    found = some.select("chunk", get("severity", "info"), get("type", "unknown"), get("description", ""))
    bad = f.where("_v IS NULL").select("chunk", F.lit("info").alias("severity"), F.lit("parse_error").alias("type"), F.concat(F.lit("could not parse LLM reply as JSON: '"), F.substring("_t", 1, 200), F.lit("'")).alias("description"))
    return found.unionByName(bad)


def offline_reply(chunks: DataFrame) -> DataFrame:
    """The stub reviewer, which finds nothing."""
    return chunks.withColumn("reply", F.lit('{"findings": []}'))


def review_report(chunks: DataFrame, findings: DataFrame) -> DataFrame:
    """(book, page_no, section): a chunk's section of the review report."""
    row = F.concat(F.lit("- **"), F.upper("severity"), F.lit("** `"), F.col("type"), F.lit("` — "), F.col("description"))
    listed = findings.groupBy("book", "page_no").agg(F.array_join(F.sort_array(F.collect_list(row)), "\n").alias("rows"))
    head = F.concat(F.lit("## PDF page "), F.col("page_no").cast("string"), F.lit(" → `"), F.coalesce(F.nullif("member", F.lit("")), F.lit("<unaligned>")), F.lit("`\n\n"))
    anchor = F.when(F.col("anchor") != "", F.concat(F.lit("_anchor: `"), F.col("anchor"), F.lit("`_\n"))).otherwise("_anchor: (no suitable phrase found on this page)_\n")
    span = F.when(F.col("member") != "", F.concat(F.lit("_EPUB paragraph range: ["), F.col("para_start").cast("string"), F.lit(", "), F.col("para_end").cast("string"), F.lit(")_\n"))).otherwise("")
    out = chunks.join(listed, ["book", "page_no"], "left")
    return out.select("book", "page_no", F.concat(head, anchor, span, F.lit("\n"), F.coalesce("rows", F.lit("- _no findings_")), F.lit("\n")).alias("section"))


def shorten(x: Column, most: int = 64, kept: int = 32) -> Column:
    """Long encoded data cut for a dump."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, kept), F.format_string("...<truncated %d bytes>", F.length(x)))).otherwise(x)
