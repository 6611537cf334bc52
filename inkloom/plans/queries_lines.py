"""Queries over lines: scans, repair passes and inline rewrites, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions import rules
from inkloom.operators import lines as L
from inkloom.operators import tidy as T
from inkloom.sources.fixtures import DUCK_LINES, md_lines

WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pass(step):
    return lambda spark, sf_dir: step(md_lines(spark, sf_dir)).select("doc", "line_no", "line")


def _q(text: str) -> str:
    return text.replace("'", "''")


def _sql(line: str, where: str = "TRUE", source: str = "md") -> str:
    return f"WITH {DUCK_LINES} SELECT doc, line_no, {line} AS line FROM {source} WHERE {where}"


def _in(words) -> str:
    return "(" + ", ".join(f"'{_q(w)}'" for w in words) + ")"


def _fenced(marker: str = r"^\s*(```|~~~)", inclusive: bool = True) -> str:
    before = f"coalesce(sum(CASE WHEN regexp_matches(line, '{marker}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    state = f"({before} % 2 = 1)"
    return f"(regexp_matches(line, '{marker}') OR {state})" if inclusive else state


def _rewritten(pattern: str, change: str, x: str = "line") -> str:
    """x with every match m of the pattern replaced by change, in DuckDB's lists."""
    p = _q(pattern)
    return f"array_to_string(list_transform(list_zip(string_split_regex({x}, '{p}'), list_append(list_transform(regexp_extract_all({x}, '{p}'), lambda m: {change}), '')), lambda z: z[1] || z[2]), '')"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# --- scans
add("scan_text", lambda s, d: _table(s, d, "documents").select("doc_id", "text"), "SELECT doc_id, text FROM documents")
add(
    "scan_lines",
    lambda s, d: L.to_lines(_table(s, d, "documents"), "doc_id").select("doc", F.col("line_no").cast("int").alias("line_no"), "line"),
    "SELECT doc_id AS doc, CAST(unnest(generate_series(0, len(l) - 1)) AS INT) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text <> '')",
)
add("merge_lines", lambda s, d: L.to_text(L.to_lines(_table(s, d, "documents"), "doc_id"), ""), "SELECT doc_id AS doc, text FROM documents WHERE text <> ''")
add("md_fixture", lambda s, d: md_lines(s, d), f"WITH {DUCK_LINES} SELECT * FROM md")
add("fence_mask", lambda s, d: L.fence_mask(md_lines(s, d)), f"WITH {DUCK_LINES} SELECT doc, line_no, line, {_fenced()} AS fenced FROM md")
add("fence_state", lambda s, d: L.fence_state(md_lines(s, d)), f"WITH {DUCK_LINES} SELECT doc, line_no, line, {_fenced(inclusive=False)} AS in_fence FROM md")
add("is_structural", lambda s, d: md_lines(s, d).withColumn("structural", T.structural(F.col("line"))), f"WITH {DUCK_LINES} SELECT doc, line_no, line, regexp_matches(line, '^{WS}*(#|\\||>|```|!\\[)') AS structural FROM md")

# --- repair passes
TOC = f"""WITH {DUCK_LINES},
a AS (SELECT *, regexp_matches(line, '^\\s*\\|') OR trim(line) = '' OR regexp_matches(line, '^\\s*\\d{{1,4}}\\s*$') AS absorb FROM md),
g AS (SELECT *, sum(CASE WHEN absorb THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY line_no) AS g FROM a),
h AS (SELECT *, first_value(NOT absorb AND regexp_matches(line, '(?i)^\\s*#{{1,6}}\\s+(?:Table of )?Contents\\s*$')) OVER w AS head,
  min(CASE WHEN absorb AND trim(line) <> '' THEN line_no END) OVER (PARTITION BY doc, g) AS shown FROM g WINDOW w AS (PARTITION BY doc, g ORDER BY line_no)),
t AS (SELECT *, bool_or(line_no = shown AND regexp_matches(line, '^\\s*\\|')) OVER (PARTITION BY doc, g) AS tabled FROM h)
SELECT doc, line_no, line FROM t WHERE NOT (head AND coalesce(tabled, FALSE))"""
add("strip_toc", _pass(T.strip_toc), TOC)
add("strip_chunk_dividers", _pass(T.strip_chunk_dividers), _sql("line", "trim(line) <> '---'"))
add("strip_orphan_dashes", _pass(T.strip_orphan_dashes), _sql("line", "trim(line) <> '-'"))
BESIDE = "SELECT *, coalesce(lag(line) OVER w, '') AS p, coalesce(lead(line) OVER w, '') AS x FROM md WINDOW w AS (PARTITION BY doc ORDER BY line_no)"
add("strip_orphan_page_numbers", _pass(T.strip_page_numbers), f"WITH {DUCK_LINES}, b AS ({BESIDE}) SELECT doc, line_no, line FROM b WHERE NOT (regexp_matches(line, '^\\s*\\d{{1,4}}\\s*$') AND trim(p) = '' AND trim(x) = '')")
TITLE = r"^## Contents$"
add(
    "consolidate_title", _pass(lambda x: T.consolidate_title(x, "The Book", TITLE)),
    f"""WITH {DUCK_LINES}, t AS (SELECT *, regexp_matches(line, '(?i){TITLE}') AS hit, sum(CASE WHEN regexp_matches(line, '(?i){TITLE}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS n FROM md)
SELECT doc, line_no, CASE WHEN hit THEN '# The Book' ELSE line END AS line FROM t WHERE NOT hit OR n = 1
UNION ALL SELECT doc, CAST(o AS BIGINT), CASE o WHEN -2 THEN '# The Book' ELSE '' END FROM (SELECT doc FROM t GROUP BY doc HAVING max(n) = 0), (SELECT unnest([-2, -1]) AS o)""",
)
H2 = f"regexp_extract(line, '^##\\s+(.+?)\\s*$', 1)"
add("promote_pillars", _pass(T.promote_pillars), _sql(f"CASE WHEN {H2} IN {_in(rules.PILLARS)} THEN '# ' || {H2} ELSE line END"))
add(
    "demote_subsections", _pass(T.demote_subsections),
    _sql(rf"""CASE WHEN regexp_matches(line, '^##\s+[·•]\s+(.+?)\s*$') THEN '- **' || trim(regexp_extract(line, '^##\s+[·•]\s+(.+?)\s*$', 1)) || '**'
 WHEN regexp_matches(line, '^##\s+(FSI[A-Z]+\d+-BP\d+.*?)\s*$') THEN '#### ' || {H2} WHEN regexp_matches(line, '^##\s+(FSI[A-Z]+\d+[A-Z]?:\s+.+?)\s*$') THEN '### ' || {H2}
 WHEN regexp_matches(line, '^(?:##|####)\s+({rules.LABELS})\s*$') THEN '##### ' || regexp_extract(line, '^(?:##|####)\s+({rules.LABELS})\s*$', 1)
 WHEN {H2} IN {_in(rules.SUBSECTIONS)} THEN '### ' || {H2} ELSE line END"""),
)
add("indent_lettered_sublists", _pass(T.indent_lettered), _sql(r"regexp_replace(line, '^- ([a-z])\.\s+(.+)$', '  - \1. \2')"))
GAPS = f"""WITH {DUCK_LINES}, i AS (SELECT *, CASE WHEN trim(line) <> '' THEN line END AS shown FROM md),
n AS (SELECT *, last_value(shown IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
  first_value(shown IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM i)
SELECT doc, line_no, line FROM n WHERE NOT (shown IS NULL AND coalesce(regexp_matches(a, '{rules.LIST_ITEM}') AND regexp_matches(b, '{rules.LIST_ITEM}') AND regexp_extract(a, '{rules.LIST_ITEM}', 1) = regexp_extract(b, '{rules.LIST_ITEM}', 1), FALSE))"""
add("heal_list_gaps", _pass(T.heal_list_gaps), GAPS)
HYPHEN = r"([\p{L}\p{N}_]+)-\s+([a-z][a-z][\p{L}\p{N}_]*)"
add(
    "heal_hyphen_breaks", _pass(T.heal_hyphens),
    _sql(_rewritten(HYPHEN, f"CASE WHEN regexp_full_match(regexp_extract(m, '{HYPHEN}', 1), '[A-Za-z]+') AND regexp_extract(m, '{HYPHEN}', 2) NOT IN {_in(rules.FUNCTION_WORDS)} THEN regexp_replace(m, '-\\s+', '-') ELSE m END")),
)
SENTENCE = f"""WITH {DUCK_LINES},
f AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS r FROM md),
full_rows AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS k, lead(line) OVER (PARTITION BY doc ORDER BY line_no) AS nx, lead(r) OVER (PARTITION BY doc ORDER BY line_no) AS nr FROM f WHERE trim(line) <> ''),
e AS (SELECT *, coalesce(NOT regexp_matches(line, '^\\s*(#|\\||>|```|!\\[)') AND NOT regexp_matches(line, '[.!?:;"”’)\\]}}]\\s*$') AND nr > r + 1 AND regexp_matches(nx, '^\\p{{Ll}}')
  AND NOT regexp_matches(nx, '^\\s*(#|\\||>|```|!\\[)') AND NOT regexp_matches(nx, '{rules.LIST_ITEM}'), FALSE) AS edge FROM full_rows),
runs AS (SELECT *, k - row_number() OVER (PARTITION BY doc, edge ORDER BY k) AS run FROM e),
fired AS (SELECT *, edge AND row_number() OVER (PARTITION BY doc, edge, run ORDER BY k) % 2 = 1 AS fires FROM runs),
gone AS (SELECT doc, r AS lo, nr AS hi FROM fired WHERE fires)
SELECT f.doc, f.line_no, CASE WHEN x.fires THEN rtrim(f.line) || ' ' || ltrim(x.nx) ELSE f.line END AS line
FROM f LEFT JOIN fired x ON f.doc = x.doc AND f.r = x.r
WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc = f.doc AND f.r > g.lo AND f.r <= g.hi)"""
add("heal_broken_sentences", _pass(T.heal_sentences), SENTENCE)
DIGIT = r"""CASE WHEN NOT regexp_matches(line, '^(#+)\s+(\d.*)$') THEN line
 WHEN regexp_matches(rest, '^(\d+)[.)]\s+(.+)$') THEN marks || ' Step ' || regexp_replace(rest, '^(\d+)[.)]\s+(.+)$', '\1: \2')
 WHEN regexp_matches(rest, '^(\d+)\s+(.+)$') THEN marks || ' Step ' || regexp_replace(rest, '^(\d+)\s+(.+)$', '\1: \2') ELSE marks || ' Ref. ' || rest END"""
add(
    "fix_digit_headings", _pass(T.fix_digit_headings),
    rf"""WITH {DUCK_LINES}, r AS (SELECT *, regexp_extract(line, '^(#+)\s+(\d.*)$', 1) AS marks, regexp_replace(trim(regexp_extract(line, '^(#+)\s+(\d.*)$', 2)), '[:：.]+$', '') AS rest FROM md WHERE NOT regexp_matches(line, '^#+\s+[^\p{{L}}\p{{N}}]+\s*$'))
SELECT doc, line_no, {DIGIT} AS line FROM r""",
)
WORDS = r"[\p{L}\p{N}_]+"
GLUED = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in rules.GLUED.items()) + "}"
GUARD = "('/', chr(92), '.')"
add(
    "un_glue_compounds", _pass(T.unglue_compounds),
    f"""WITH {DUCK_LINES}, s AS (SELECT *, string_split_regex(line, '{WORDS}') AS ps, regexp_extract_all(line, '{WORDS}') AS ws FROM md),
c AS (SELECT *, list_transform(ws, lambda w, i: CASE WHEN {GLUED}[w] IS NOT NULL AND right(ps[i], 1) NOT IN {GUARD} AND left(ps[i + 1], 1) NOT IN {GUARD} THEN {GLUED}[w] ELSE w END) AS vs FROM s)
SELECT doc, line_no, array_to_string(list_transform(list_zip(ps, list_append(vs, '')), lambda z: z[1] || z[2]), '') AS line FROM c""",
)
spaces = "line"
for wrong, right in rules.SPACE_FIXES.items():
    spaces = f"regexp_replace({spaces}, '(^|[^\\p{{L}}\\p{{N}}_]){wrong}($|[^\\p{{L}}\\p{{N}}_])', '\\1{right}\\2', 'g')"
add("heal_intra_word_spaces", _pass(T.heal_spaces), _sql(spaces))
EMPHASIS = r"\*\*[^\n]+?\*\*|__[^\n]+?__"
add("strip_emphasis_inner_space", _pass(T.strip_emphasis_space), _sql(_rewritten(EMPHASIS, "CASE WHEN trim(substr(m, 3, length(m) - 4)) = '' THEN m ELSE left(m, 2) || trim(substr(m, 3, length(m) - 4)) || right(m, 2) END")))
seams = "line"
for pattern, by in rules.ADJACENCY:
    seams = f"regexp_replace({seams}, '{_q(pattern)}', '\\1 \\2', 'g')"
add("space_markdown_adjacency", _pass(T.space_adjacency), _sql(seams))
add("strip_placeholder_image_alt", _pass(T.strip_image_alt), f"WITH {DUCK_LINES}, f AS (SELECT *, {_fenced()} AS fenced FROM md) SELECT doc, line_no, CASE WHEN fenced THEN line ELSE regexp_replace(line, '(?i)!\\[\\s*image\\s*\\]\\(', '![](', 'g') END AS line FROM f")
add(
    "normalize_relative_links", _pass(T.absolute_links),
    _sql(rf"regexp_replace(regexp_replace(line, '\]\((?:\./)+([^):\s]+)\)', ']({rules.REL_BASE}\1)', 'g'), '(^|[^!])(\[[^\]]*\])\(([a-z]+/[^):\s]+)\)', '\1\2({rules.REL_BASE}\3)', 'g')"),
)
add("apply_corpus_fixes", _pass(T.corpus_fixes), _sql("regexp_replace(line, '(^|[^\\p{L}\\p{N}_])WellArchitected($|[^\\p{L}\\p{N}_])', '\\1Well-Architected\\2', 'g')"))
def _free(change: str) -> str:
    return f"WITH {DUCK_LINES}, f AS (SELECT *, {_fenced()} AS fenced FROM md) SELECT doc, line_no, CASE WHEN fenced THEN line ELSE {change} END AS line FROM f"


BODY = "substr(m, 3, length(m) - 4)"
ALIGNED = f"CASE WHEN (contains({BODY}, '&') OR contains({BODY}, chr(92) || chr(92))) AND NOT contains({BODY}, chr(92) || 'begin{{') THEN '$$' || chr(92) || 'begin{{aligned}}' || {BODY} || chr(92) || 'end{{aligned}}$$' ELSE m END"
add("wrap_aligned_math", _pass(T.wrap_aligned), _free(_rewritten(r"\$\$.+?\$\$", ALIGNED)))
add("escape_prose_dollars", _pass(T.escape_dollars), _free(_rewritten(r"\$\$.*?\$\$|`+[^`]*`+|\\\$|\$", "CASE WHEN m = '$' THEN chr(92) || '$' ELSE m END")))
add("promote_numbered_chapters", _pass(T.number_chapters))
add("tidy", lambda s, d: T.tidy(md_lines(s, d), math=True).select("doc", "line_no", "line"))
add("tidy_generic", lambda s, d: T.tidy(md_lines(s, d), "generic").select("doc", "line_no", "line"))
add("tidy_text", lambda s, d: L.to_text(T.tidy(md_lines(s, d))))


def _chained(names: list[str], out: str = "SELECT doc, line_no, line FROM md") -> str:
    """SQL of passes one after another, each over what the one before gives."""
    begin = f"WITH {DUCK_LINES}"
    for name in names:
        step = ONE_TITLE if name == "consolidate_title" else SQL[name]
        out = f"WITH md AS MATERIALIZED (SELECT doc, line_no, line FROM ({out})){step.removeprefix(begin)}"
    return f"WITH {DUCK_LINES} SELECT doc, line_no, line FROM ({out})"


# without a title given, the first line that matches becomes the title as it stands
ONE_TITLE = f"""WITH {DUCK_LINES}, t AS (SELECT *, regexp_matches(line, '(?i){_q(rules.TITLE)}') AS hit, sum(CASE WHEN regexp_matches(line, '(?i){_q(rules.TITLE)}') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS n FROM md)
SELECT doc, line_no, CASE WHEN hit THEN '# ' || trim(regexp_replace(line, '^#+', '')) ELSE line END AS line FROM t WHERE NOT hit OR n = 1"""
AWS = (
    "strip_toc strip_chunk_dividers strip_orphan_dashes strip_orphan_page_numbers consolidate_title promote_pillars demote_subsections indent_lettered_sublists heal_list_gaps heal_hyphen_breaks "
    "heal_broken_sentences fix_digit_headings un_glue_compounds heal_intra_word_spaces strip_emphasis_inner_space space_markdown_adjacency strip_emphasis_inner_space strip_placeholder_image_alt normalize_relative_links apply_corpus_fixes"
).split()
SQL["tidy"] = _chained([*AWS, "wrap_aligned_math", "escape_prose_dollars"])
SQL["tidy_text"] = f"SELECT doc, string_agg(line, chr(10) ORDER BY line_no) || chr(10) AS text FROM ({_chained(AWS)}) GROUP BY doc"
