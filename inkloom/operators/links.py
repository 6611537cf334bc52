"""Links: extraction, address functions, and recovery of lost links by joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions import rules
from inkloom.functions.text import all_matches, group, like, rewrite, strip, sub

KEY_LINK = r"\[((?:[^\[\]]|\[[^\]]*\])+)\]\(([^)]+)\)"


def norm_text(x: Column) -> Column:
    return F.lower(strip(sub(x, r"\s+", " ")))


def normalize_uri(x: Column, base: str = rules.REL_BASE) -> Column:
    flat = strip(F.replace(x, F.lit("\\"), F.lit("/")))
    return F.when(flat.contains("://") | flat.rlike("^(mailto:|tel:|#)"), flat).otherwise(F.concat(F.lit(base), F.regexp_replace(flat, "^/+", "")))


def clean_annotations(pairs: DataFrame, base: str = rules.REL_BASE) -> DataFrame:
    """Link annotations with white space made single, addresses absolute, and texts of three characters or more."""
    text = strip(sub(F.col("text"), r"\s+", " "))
    return pairs.select("seq", text.alias("text"), normalize_uri(F.col("uri"), base).alias("uri")).where(F.length("text") > 2)


def safe_keys(pairs: DataFrame, stop=tuple(rules.STOP_TEXTS)) -> DataFrame:
    """Pairs whose text is neither a stop text (anti-join) nor one short word."""
    spark = pairs.sparkSession
    named = pairs.withColumn("norm", norm_text(F.col("text")))
    kept = named.join(spark.createDataFrame([(w,) for w in stop], "norm string"), "norm", "left_anti")
    return kept.where(F.col("norm").contains(" ") | (F.length("norm") >= 6))


def first_uri(pairs: DataFrame) -> DataFrame:
    """(text, uri, n, seq): the first address of each text, and how often the text occurs."""
    return pairs.groupBy("text").agg(F.min_by("uri", "seq").alias("uri"), F.count("*").alias("n"), F.min("seq").alias("seq"))


def _pattern(key: Column) -> Column:
    quoted = F.regexp_replace(key, r"([^\p{L}\p{N}_\s])", r"\\$1")
    return F.concat(F.lit(r"(?iU)\b"), F.regexp_replace(quoted, r"\s+", r"\\s+"), F.lit(r"\b"))


def _block(key: Column) -> Column:
    """The longest word run of a key, in lower case; every line that has the key has this run."""
    words = F.transform(all_matches(key, r"\w+"), lambda w: F.struct(F.length(w).alias("n"), F.lower(w).alias("w")))
    return F.array_max(words)["w"]


def line_words(lines: DataFrame) -> DataFrame:
    return lines.withColumn("word", F.explode(F.array_distinct(F.transform(all_matches(F.col("line"), r"\w+"), lambda w: F.lower(w)))))


def candidates(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """Lines beside the keys they may hold: an equi-join on one word of the key, in place of a containment join."""
    return line_words(lines).join(keys.withColumn("word", _block(F.col("text"))).where("word IS NOT NULL"), "word").drop("word")


def common_keys(lines: DataFrame, keys: DataFrame, factor: int = 3) -> DataFrame:
    """(doc, text, hits) of the single-word keys (text, n) that a document holds more than factor * n times."""
    single = keys.where(~strip(F.col("text")).contains(" "))
    found = candidates(lines, single).groupBy("doc", "text").agg(F.sum(F.regexp_count("line", _pattern(F.col("text")))).alias("hits"), F.max("n").alias("n"))
    return found.where(F.col("hits") > factor * F.col("n")).select("doc", "text", "hits")


def restore_links(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lines with the first key they hold made a link; a line that has a link stays.

    Of the keys at the leftmost place the longest is taken, of equals the first.  Keys
    that are alike but for case and spacing share the address of the longest, then first.
    """
    keys = first_uri(safe_keys(pairs).select("seq", "text", "uri"))
    w = Window.partitionBy("norm").orderBy(F.desc(F.length("text")), "seq")
    named = keys.withColumn("norm", norm_text(F.col("text"))).withColumn("uri", F.first("uri").over(w))
    free = lines.where(~like(F.col("line"), rules.ANY_LINK))
    met = candidates(free, named).join(common_keys(lines, named), ["doc", "text"], "left_anti")
    unbracketed = F.concat(F.lit(r"(?iU)(?<!\[)"), F.expr("substr(p, 6)"))
    met = met.withColumn("p", _pattern(F.col("text"))).withColumn("at", F.regexp_instr("line", unbracketed)).where("at > 0")
    met = met.withColumn("matched", F.regexp_substr("line", unbracketed))
    best = met.groupBy("doc", "line_no").agg(F.min_by(F.struct("at", "matched", "uri"), F.struct("at", (-F.length("text")).alias("l"), "seq")).alias("b"))
    spliced = F.concat(F.expr("substr(line, 1, b.at - 1)"), F.lit("["), F.col("b.matched"), F.lit("]("), F.col("b.uri"), F.lit(")"), F.expr("substr(line, b.at + length(b.matched))"))
    return lines.join(best, ["doc", "line_no"], "left").select("doc", "line_no", F.when(F.col("b").isNotNull(), spliced).otherwise(F.col("line")).alias("line"), F.col("b").isNotNull().alias("restored"))


def extract_links(lines: DataFrame) -> DataFrame:
    """(doc, line_no, pos, text, href) of every link, images included; one level of brackets may stand in the text."""
    found = lines.where(F.col("line").contains("](")).select("doc", "line_no", F.posexplode(all_matches(F.col("line"), KEY_LINK)).alias("pos", "m"))
    return found.select("doc", "line_no", "pos", group(F.col("m"), KEY_LINK, 1).alias("text"), group(F.col("m"), KEY_LINK, 2).alias("href"))


def unique_urls(lines: DataFrame) -> DataFrame:
    """(doc, url, ord): web addresses in order of first appearance."""
    pattern = r"\]\((https?://[^)\s]+)\)"
    found = lines.where(F.col("line").contains("](http")).select("doc", "line_no", F.posexplode(all_matches(F.col("line"), pattern, 1)).alias("pos", "url"))
    first = found.groupBy("doc", "url").agg(F.min(F.struct("line_no", "pos")).alias("at"))
    return first.select("doc", "url", F.row_number().over(Window.partitionBy("doc").orderBy("at")).alias("ord"))


def keep_url(url: Column, keep=tuple(rules.KEEP_URLS), skip=tuple(rules.SKIP_URLS)) -> Column:
    some = lambda patterns: reduce(lambda a, b: a | b, [url.rlike(p) for p in patterns], F.lit(False))
    return ~some(skip) & some(keep)


def remove_dots(path: Column) -> Column:
    """An absolute path without its '.' and '..' segments."""
    parts = F.split(path, "/", -1)
    step = lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p)))
    out = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path.rlike(r"/\.{1,2}$"), F.concat(out, F.lit("/"))).otherwise(out)


def url_join(base: Column, href: Column) -> Column:
    """href as seen from the page at base (RFC 3986)."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "^/", ""))
    own, rest = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_replace(href, "^[^?#]*", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href == "", F.regexp_replace(base, "#.*$", "")).when(href.startswith("#"), F.concat(root, path, query, href)).when(href.startswith("?"), F.concat(root, path, href))
        .when(href.startswith("/"), F.concat(root, remove_dots(own), rest)).otherwise(F.concat(root, remove_dots(F.concat(folder, own)), rest))
    )


def absolutize(body: Column, source: Column) -> Column:
    """Relative links of a body made absolute against its source."""

    def change(m: Column) -> Column:
        text, href = group(m, KEY_LINK, 1), strip(group(m, KEY_LINK, 2))
        return F.when(href.rlike("^(https?://|mailto:|tel:)"), m).otherwise(F.concat(F.lit("["), text, F.lit("]("), url_join(source, href), F.lit(")")))

    return rewrite(body, KEY_LINK, change)


def url_key(url: Column) -> Column:
    return F.sha1(url)


def file_key(path: Column, mtime: Column, size: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", path, mtime.cast("string"), size.cast("string"))), 1, 16)


def uncached(urls: DataFrame, cache: DataFrame, *owner: str) -> DataFrame:
    """Addresses without an entry (key) in the cache table, or without one of the same owner (columns of both)."""
    return urls.withColumn("key", url_key(F.col("url"))).join(cache.select("key", *owner), ["key", *owner], "left_anti")
