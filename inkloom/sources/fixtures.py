"""Derived tables: books of marked-up lines and the like, made from the driver's tables by one recipe in two SQL dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.sources.pages import html_facts

#: What each class of source line becomes: SQL string expressions over s, w, b, n and book that both dialects read the same way.
TEMPLATES: dict[int, list[str]] = {
    0: ["''", "'## ' || s", "''"],
    1: ["''", "'- ' || w", "''", "'- ' || b", "''"],
    2: ["''", "cast(n % 1200 as string)", "''"],
    3: ["b", "''", "lower(substr(s, 1, 1)) || substr(s, 2)"],
    4: ["'```'", "'# ' || w", "'#SBATCH -n 1'", "'```'"],
    5: ["'## Contents'", "'| a .... 1 |'", "''", "'7'", "'| b .... 2 |'", "s"],
    6: ["'---'", "s"],
    7: ["'-'", "s"],
    8: ["'## ' || cast(1 + n % 3 as string) || '.' || cast(1 + n % 4 as string) || ' ' || w"],
    9: ["'## 0' || cast(1 + n % 3 as string)", "''", "'## MAIN TOPIC'"],
    10: ["'![Image](img/a.png) ' || w"],
    11: ["'See [' || w || '](./foo' || cast(n as string) || '.html) end'"],
    12: ["'See[' || w || '](https://example.com/' || cast(book % 50 as string) || ')now'"],
    13: ["'**' || w || ' ** then ' || w"],
    14: ["'real- time and over- or under- use'"],
    15: ["'a realtime longterm plan https://e.com/realtime/x'"],
    16: ["'| a | b |'", "'| - | - |'", "'| 1 | 2 |'"],
    17: ["'| lone | row |'", "'|'"],
    18: [f"w || ' ........ ' || '{i}'" for i in range(1, 6)],
    19: ["'#SBATCH --time=1'"],
    20: ["'## •'"],
    21: ["'##'"],
    22: ["'cost $5 and $$a & b$$ end'"],
    23: ["'- a. ' || w"],
    24: ["'[[X.1] ' || w || '](./bar.html)'"],
    25: ["'cafÃ© â€™ ' || w"],
    26: ["'http://e.com' || chr(92) || 'a' || chr(92) || 'b'"],
    27: ["'## 3. Do it:'"],
    28: ["s"],
}


def _emitted(spark: bool) -> str:
    array = (lambda xs: f"array({', '.join(xs)})") if spark else (lambda xs: f"[{', '.join(xs)}]")
    cases = " ".join(f"WHEN {k} THEN {array(xs)}" for k, xs in TEMPLATES.items())
    return f"CASE (book * 31 + n * 17) % 29 {cases} END"


#: A source's documents are cut into books of 10,000 ids, so that books grow in number and not in length.
BOOK = "cast(substr(source, 4) AS int) + 20 * cast(floor(doc_id / 10000) AS int)"
SPARK_LINES = f"""
WITH raw AS (
  SELECT doc_id, source, {BOOK} AS book, p.pos, p.s
  FROM {{documents}} LATERAL VIEW posexplode(split(text, '\\n', -1)) p AS pos, s),
numbered AS (SELECT book, s, row_number() OVER (PARTITION BY book ORDER BY doc_id, pos) - 1 AS n FROM raw),
words AS (SELECT *, coalesce(nullif(regexp_extract(s, '[A-Za-z]+', 0), ''), 'word') AS w, regexp_replace(s, '[.!?]+$', '') AS b FROM numbered),
made AS (SELECT book, n, {_emitted(True)} AS xs FROM words),
flat AS (SELECT book, n, e.i, e.line FROM made LATERAL VIEW posexplode(xs) e AS i, line)
SELECT book AS doc, cast(row_number() OVER (PARTITION BY book ORDER BY n, i) - 1 AS bigint) AS line_no, line FROM flat"""

DUCK_LINES = f"""raw AS (
  SELECT doc_id, source, {BOOK} AS book, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS s
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)),
numbered AS (SELECT book, s, row_number() OVER (PARTITION BY book ORDER BY doc_id, pos) - 1 AS n FROM raw),
words AS (SELECT *, coalesce(nullif(regexp_extract(s, '[A-Za-z]+', 0), ''), 'word') AS w, regexp_replace(s, '[.!?]+$', '') AS b FROM numbered),
made AS (SELECT book, n, {_emitted(False)} AS xs FROM words),
flat AS (SELECT book, n, unnest(generate_series(0, len(xs) - 1)) AS i, unnest(xs) AS line FROM made),
md AS (SELECT book AS doc, cast(row_number() OVER (PARTITION BY book ORDER BY n, i) - 1 AS bigint) AS line_no, line FROM flat)"""

FACTS = {
    "members": "SELECT cast(page_id % 20 AS int) AS book, 'm' || lpad(cast(page_id AS string), 4, '0') || '.xhtml' AS member, page_id FROM {pages}",
    "ids": """SELECT book, member, 1 AS line, 'sec-' || cast(page_id % 7 AS string) AS id FROM members
      UNION ALL SELECT book, member, 2, '9bad' FROM members WHERE page_id % 11 = 0""",
    "hrefs": """SELECT book, member, 3 AS line, 'm' || lpad(cast(page_id + 20 AS string), 4, '0') || '.xhtml#sec-' || cast(page_id % 9 AS string) AS href FROM members
      UNION ALL SELECT book, member, 4, './p' || cast(page_id AS string) || '.html' FROM members WHERE page_id % 5 = 0
      UNION ALL SELECT m.book, m.member, cast(5 + s.i AS int), 'https://example.com/' || cast(s.i AS string) FROM members m, fifty s WHERE m.page_id % 50 = 0""",
    "headings": """SELECT m.book, m.member, cast(100 + s.i AS int) AS line, cast(1 + (m.page_id * s.i) % 6 AS int) AS level,
      CASE WHEN s.i = 1 THEN 'Overview' ELSE 'Part ' || cast((m.page_id + s.i) % 40 AS string) END AS text FROM members m, fifty s WHERE s.i BETWEEN 1 AND 6""",
    "images": """SELECT book, member, 9 AS line, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'alt' END AS alt,
      CASE WHEN page_id % 4 = 0 THEN 'icons/x.png' ELSE 'img/' || cast(page_id AS string) || '.png' END AS src,
      CASE WHEN page_id % 5 = 0 THEN 'presentation' END AS role FROM members""",
    "body_stats": """SELECT book, CASE WHEN page_id % 17 = 0 THEN 'nav' || member ELSE member END AS member, CASE WHEN page_id % 6 = 0 THEN 0 ELSE page_id END AS body_len FROM members""",
    "manifest": """SELECT book, 'i' || cast(page_id AS string) AS id, CASE WHEN page_id % 9 = 0 THEN 'gone/' ELSE '' END || member AS href FROM members WHERE page_id % 13 <> 0""",
    "spine": """SELECT book, 'i' || cast(page_id AS string) AS idref FROM members WHERE page_id % 13 <> 0
      UNION ALL SELECT DISTINCT book, 'ghost' FROM members WHERE book % 4 = 0""",
}
#: What is read from the pages themselves, in DuckDB SQL: hrefs and first headings, with the lines they stand in.
DUCK_READ = {
    "hrefs": """SELECT m.book, m.member, l.line, unnest(regexp_extract_all(l.s, '<a href="([^"]*)"', 1)) AS href FROM members m JOIN page_lines l ON l.page_id = m.page_id""",
    "headings": """SELECT book, member, line, 1 AS level, trim(replace(replace(replace(replace(h, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')) AS text
      FROM (SELECT m.book, m.member, l.line, unnest(regexp_extract_all(l.s, '<h1>(.*?)</h1>', 1)) AS h FROM members m JOIN page_lines l ON l.page_id = m.page_id)""",
}
DUCK_PAGE_LINES = "page_lines AS (SELECT page_id, cast(unnest(generate_series(1, len(ls))) AS int) AS line, unnest(ls) AS s FROM (SELECT page_id, string_split(html, chr(10)) AS ls FROM pages))"
SPARK_FIFTY = "SELECT explode(sequence(0, 50)) AS i"
DUCK_FIFTY = "SELECT unnest(generate_series(0, 50)) AS i"


def _path(sf_dir: str, name: str) -> str:
    return f"parquet.`{sf_dir}/{name}.parquet`"


def md_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, line_no, line): books of marked-up lines made from all documents, twenty for every 10,000 ids."""
    return spark.sql(SPARK_LINES.format(documents=_path(sf_dir, "documents")))


def facts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Facts about the members of the books of pages, of which hrefs and headings are also read from the pages: members, ids, hrefs, headings, images, body_stats, manifest, spine."""
    members = f"members AS ({FACTS['members'].format(pages=_path(sf_dir, 'pages'))})"
    recipe = FACTS[name] if name != "members" else "SELECT * FROM members"
    if name == "headings":  # with the page, which orders the headings of members of one name
        recipe = recipe.replace("SELECT m.book", "SELECT m.page_id, m.book", 1)
    made = spark.sql(f"WITH {members}, fifty AS ({SPARK_FIFTY}) {recipe}")
    if name not in DUCK_READ:
        return made
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    read = html_facts(pages).join(facts(spark, sf_dir, "members"), "page_id")
    if name == "hrefs":
        read = read.where("kind = 'href'").select("book", "member", "line", F.col("value").alias("href"))
    else:
        read = read.where("kind = 'heading' AND level = 1").select("page_id", "book", "member", "line", "level", F.col("value").alias("text"))
    return made.unionByName(read)


def duck_facts(*names: str) -> str:
    """The same as common table expressions of DuckDB SQL."""
    parts = [f"members AS ({FACTS['members'].format(pages='pages')})", f"fifty AS ({DUCK_FIFTY})"]
    parts += [DUCK_PAGE_LINES] if set(names) & set(DUCK_READ) else []
    return ", ".join(parts + [f"{n} AS ({FACTS[n]}{' UNION ALL ' + DUCK_READ[n] if n in DUCK_READ else ''})" for n in names])


def link_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, text, uri): phrases of the benchmark passages, two stop texts and three words that occur everywhere."""
    return spark.sql(PAIRS.format(benchmark=_path(sf_dir, "benchmark")))


PAIRS = """SELECT item_id AS seq, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) AS text, 'https://example.com/b/' || cast(item_id AS string) AS uri FROM {benchmark}
UNION ALL SELECT 10001, 'here', 'https://example.com/here' UNION ALL SELECT 10002, 'Details', 'https://example.com/d'
UNION ALL SELECT 10003, 'longterm', 'https://example.com/l' UNION ALL SELECT 10004, 'MAIN TOPIC', 'foo' || chr(92) || 'bar.html'"""


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(epub, member, content): archives of fifty pages each, with a container and a package file; of each seven one has no container, one a broken package."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html", F.floor(F.col("page_id") / 50).cast("bigint").alias("k"))
    epub = F.concat(F.lit("b"), F.col("k"))
    page = pages.select(epub.alias("epub"), F.concat(F.lit("o/m"), "page_id", F.when(F.col("page_id") % 4 == 1, ".HTML").otherwise(".xhtml")).alias("member"), F.encode("html", "UTF-8").alias("content"))
    item = F.concat(F.lit('<item id="i'), "page_id", F.lit('" href="m'), "page_id", F.lit('.xhtml"/>'))
    ref = F.concat(F.lit('<itemref idref="i'), "page_id", F.lit('"/>'))
    whole = F.concat(F.lit('<package xmlns="urn:opf"><manifest>'), F.array_join(F.sort_array(F.collect_list(item)), ""), F.lit("</manifest><spine>"), F.array_join(F.sort_array(F.collect_list(ref)), ""), F.lit("</spine></package>"))
    opf = pages.groupBy("k").agg(whole.alias("x")).select(epub.alias("epub"), F.lit("o/c.opf").alias("member"), F.encode(F.when(F.col("k") % 7 == 4, "<package").otherwise(F.col("x")), "UTF-8").alias("content"))
    box = F.lit('<container xmlns="urn:c"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
    rest = pages.select("k").distinct().select("k", epub.alias("epub"))
    container = rest.where("k % 7 <> 3").select("epub", F.lit("META-INF/container.xml").alias("member"), F.encode(box, "UTF-8").alias("content"))
    kind = rest.select("epub", F.lit("mimetype").alias("member"), F.encode(F.lit("application/epub+zip"), "UTF-8").alias("content"))
    return page.unionByName(opf).unionByName(container).unionByName(kind)
