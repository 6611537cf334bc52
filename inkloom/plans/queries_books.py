"""Queries over archives, packages, sidecars, names, covers and rendered pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.operators import chunking as C
from inkloom.operators import formula as FO
from inkloom.operators import report as R
from inkloom.operators.audit import directory, resolved
from inkloom.plans.queries_lines import _table
from inkloom.plans.queries_links import BRACES, SEGS
from inkloom.sources import archives as AR
from inkloom.sources import pages as P
from inkloom.sources.fixtures import DUCK_LINES, archives, md_lines

QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def opened(spark, sf_dir):
    """The members of archives that were packed and opened again."""
    packed = AR.repack(archives(spark, sf_dir)).select(F.col("epub").alias("path"), "content")
    return AR.unzipped(packed)


BOOKS = "bk AS (SELECT DISTINCT CAST(floor(page_id / 50) AS BIGINT) AS k FROM pages)"
MEMBER = "'o/m' || page_id || CASE WHEN page_id % 4 = 1 THEN '.HTML' ELSE '.xhtml' END"
KEY = "CAST(floor(page_id / 50) AS BIGINT)"
ITEMS = """array_to_string(list_sort(list('<item id="i' || page_id || '" href="m' || page_id || '.xhtml"/>')), '')"""
REFS = """array_to_string(list_sort(list('<itemref idref="i' || page_id || '"/>')), '')"""
OPF = f"""(SELECT {KEY} AS k, '<package xmlns="urn:opf"><manifest>' || {ITEMS} || '</manifest><spine>' || {REFS} || '</spine></package>' AS x FROM pages GROUP BY {KEY})"""
BOX = """'<container xmlns="urn:c"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>'"""
ALL = f"""(SELECT 'b' || {KEY} AS epub, {MEMBER} AS member, octet_length(encode(html)) AS n FROM pages
  UNION ALL SELECT 'b' || k, 'o/c.opf', CASE WHEN k % 7 = 4 THEN 8 ELSE octet_length(encode(x)) END FROM {OPF}
  UNION ALL SELECT 'b' || k, 'META-INF/container.xml', length({BOX}) FROM bk WHERE k % 7 <> 3
  UNION ALL SELECT 'b' || k, 'mimetype', 20 FROM bk)"""
add("epub_repack", lambda s, d: opened(s, d).select("epub", "member", F.octet_length("content").cast("bigint").alias("n_bytes")), f"WITH {BOOKS} SELECT epub, member, n::BIGINT AS n_bytes FROM {ALL}")
add("scan_zip_members", lambda s, d: AR.page_members(opened(s, d)).select("epub", "member"), f"SELECT 'b' || {KEY} AS epub, {MEMBER} AS member FROM pages")


def wanted(s, d):
    pages = _table(s, d, "pages").select(F.concat(F.lit("b"), F.floor(F.col("page_id") / 50).cast("bigint")).alias("epub"), "page_id")
    return pages.select("epub", F.concat(F.lit("o/m"), "page_id", F.lit(".xhtml")).alias("member"))


add("read_member", lambda s, d: AR.read_member(opened(s, d), wanted(s, d)), f"SELECT 'b' || {KEY} AS epub, 'o/m' || page_id || '.xhtml' AS member, CASE WHEN page_id % 4 = 1 THEN '' ELSE html END AS html FROM pages")
add("opf_locate", lambda s, d: AR.package(opened(s, d))[0],
    f"""WITH {BOOKS} SELECT 'b' || k AS epub, CASE WHEN k % 7 = 3 THEN 'META-INF/container.xml' ELSE 'o/c.opf' END AS opf,
    CASE k % 7 WHEN 3 THEN 'could not locate OPF rootfile' WHEN 4 THEN 'OPF is not well-formed XML: unclosed token: line 1, column 0' END AS problem FROM bk""")  # fmt: skip


def parsed(s, d):
    _, manifest, spine = AR.package(opened(s, d))
    return manifest.select("epub", F.lit("item").alias("kind"), "id", "href").unionByName(spine.select("epub", F.lit("itemref").alias("kind"), F.col("idref").alias("id"), F.lit(None).cast("string").alias("href")))


SOUND = f"pages WHERE {KEY} % 7 NOT IN (3, 4)"
add("opf_parse", parsed, f"SELECT 'b' || {KEY} AS epub, 'item' AS kind, 'i' || page_id AS id, 'm' || page_id || '.xhtml' AS href FROM {SOUND} UNION ALL SELECT 'b' || {KEY}, 'itemref', 'i' || page_id, NULL FROM {SOUND}")

# --- addresses of pages, against the page's own
HREFS = lambda s, d: P.html_facts(_table(s, d, "pages")).where("kind = 'href'").join(_table(s, d, "pages").select("page_id", "url"), "page_id")
PATH = lambda: F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://[^/]*/?", "")
add("resolve_relative", lambda s, d: HREFS(s, d).select("page_id", F.col("value").alias("href"), resolved(directory(PATH()), F.col("value")).alias("target")),
    r"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*/?', ''), '(^|/)[^/]*$', '') AS base, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
    SELECT page_id, href, array_to_string(list_filter(string_split(base || '/' || href, '/'), lambda x: x NOT IN ('', '.')), '/') AS target FROM h""")  # fmt: skip
add("build_dir", lambda s, d: _table(s, d, "pages").select("page_id", C.build_name(F.when(F.col("page_id") % 9 == 0, " .. ").otherwise(F.concat(F.lit(" "), "url"))).alias("name")),
    "SELECT page_id, CASE WHEN page_id % 9 <> 0 THEN trim(translate(url, '/' || chr(92), '__')) END AS name FROM pages")

# --- formulas: sidecars and what renders
SIDE = lambda s, d: _table(s, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("page_no"), F.struct(F.col("l_quantity").alias("l"), F.lit(1.5).alias("t"), F.lit(2.0).alias("r"), F.lit(0.5).alias("b")).alias("bbox"), F.lit("BOTTOMLEFT").alias("coord_origin"), F.lit(200.0).alias("page_w"), F.lit(100.0).alias("page_h"), F.col("l_returnflag").alias("orig"))))).alias("json")).select(F.col("l_orderkey").alias("doc"), F.when(F.col("l_orderkey") % 10 == 3, "{broken").otherwise(F.col("json")).alias("json"))
add("json_sidecar_read", lambda s, d: FO.read_boxes(SIDE(s, d)).select("doc", "page_no", "l", "t", "r", "b", "origin", "page_w", "page_h", "text"),
    "SELECT l_orderkey AS doc, l_linenumber::INT AS page_no, l_quantity AS l, 1.5::DOUBLE AS t, 2.0::DOUBLE AS r, 0.5::DOUBLE AS b, 'BOTTOMLEFT' AS origin, 200.0::DOUBLE AS page_w, 100.0::DOUBLE AS page_h, l_returnflag AS text FROM lineitem WHERE l_orderkey % 10 <> 3")
add("can_render", lambda s, d: FO.segments(md_lines(s, d)).select("doc", "ord", "body", FO.renders(F.col("body")).alias("ok")),
    f"WITH {DUCK_LINES} SELECT doc, ord, body, {BRACES} AND NOT ((contains(body, '&') OR contains(body, chr(92) || chr(92))) AND NOT contains(body, chr(92) || 'begin{{')) AS ok FROM {SEGS}")

# --- covers: a hexagon, a colour and a place for each page
PAGES = lambda s, d: _table(s, d, "pages").select("page_id", (F.col("page_id") % 100 + 10.0).alias("r"), (F.col("page_id") % 2560).cast("int").alias("y"), (F.length("url") * 7).alias("w"))
add("cover_geometry",
    lambda s, d: PAGES(s, d).select("page_id", F.posexplode(R.hexagon(F.lit(800.0), F.lit(1000.0), F.col("r"), F.lit(30))).alias("i", "c"), R.gradient(F.col("y"), F.lit(2560), F.array(F.lit(10), F.lit(20), F.lit(200)), F.array(F.lit(250), F.lit(0), F.lit(100))).alias("rgb"), R.centred(F.lit(1600), F.col("w")).alias("at")).select("page_id", "i", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"), F.col("rgb")[0].alias("red"), F.col("rgb")[1].alias("green"), F.col("rgb")[2].alias("blue"), "at"),
    """WITH p AS (SELECT page_id, page_id % 100 + 10.0::DOUBLE AS r, (page_id % 2560) / 2560.0::DOUBLE AS t, length(url) * 7 AS w, unnest(generate_series(0, 5))::INT AS i FROM pages)
    SELECT page_id, i, round(800 + r * cos(radians(60 * i + 30)), 6) AS x, round(1000 + r * sin(radians(60 * i + 30)), 6) AS y, floor(10 * (1 - t) + 250 * t)::INT AS red, floor(20 * (1 - t) + 0 * t)::INT AS green, floor(200 * (1 - t) + 100 * t)::INT AS blue, floor((1600 - w) / 2.0)::INT AS at FROM p""")  # fmt: skip
add("md_to_xhtml", lambda s, d: C.render(C.pack_sections(md_lines(s, d), 8000)).select("doc", "chapter", "part", "xhtml"))
