"""Queries of the audit: detectors over lines and facts, and reports over their findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions import rules
from inkloom.operators import audit as A
from inkloom.operators import report as R
from inkloom.plans.queries_lines import _in, _q
from inkloom.sources.fixtures import DUCK_LINES, duck_facts, facts, md_lines

QUERIES: dict = {}
SQL: dict[str, str] = {}
TABLES = ["members", "ids", "hrefs", "headings", "images", "body_stats", "manifest", "spine"]
N = r"[\p{L}\p{N}_]"


def tables(spark, sf_dir):
    return {n: facts(spark, sf_dir, n) for n in TABLES}


def _select(name, severity, message, snippet, file="CAST(doc AS VARCHAR)", line="CAST(line_no + 1 AS INT)", extra="CAST(NULL AS VARCHAR)"):
    return f"SELECT '{name}' AS detector, {severity} AS severity, {file} AS file, {line} AS line, {message} AS message, {snippet} AS snippet, {extra} AS extra"


def _md(name, severity, message, snippet, where, source="md", extra="CAST(NULL AS VARCHAR)"):
    return f"{_select(name, f'{severity!r}', message, snippet, extra=extra)} FROM {source} WHERE {where}"


def _each(pattern):
    return f"(SELECT *, unnest(regexp_extract_all(line, '{_q(pattern)}')) AS m FROM md)"


TICKS = "(SELECT *, coalesce(sum(CASE WHEN regexp_matches(line, '^\\s*```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_fence, regexp_matches(line, '^\\s*```') AS mk, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS r FROM md)"
NEAR = f"(SELECT *, first_value(CASE WHEN contains(line, '`') AND NOT mk THEN r END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS nr FROM {TICKS})"
BLOCKS = f"""(SELECT doc, k, min(line_no) AS line_no, count(*) - 1 AS n, trim(string_agg(CASE WHEN NOT mk THEN line END, chr(10) ORDER BY line_no)) AS body
  FROM (SELECT *, max(k) OVER (PARTITION BY doc) AS ks FROM (SELECT *, sum(CASE WHEN mk THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS k FROM {TICKS})) WHERE k % 2 = 1 AND ks > k GROUP BY doc, k)"""
FOUND = "CASE " + " ".join(f"WHEN contains(line, '{p}') THEN '{p}'" for p in rules.MOJIBAKE) + " END"
RUNS = "(SELECT doc, g, count(*) AS n, min(line_no) AS line_no, min_by(line, line_no) AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_no) - sum(CASE WHEN isl THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS g FROM (SELECT *, regexp_matches(line, '^.+?\\s*\\.{4,}\\s*\\d+\\s*$') AS isl FROM md)) WHERE isl GROUP BY doc, g)"
H1S = "(SELECT doc, count(*) AS n, min(line_no) AS line_no, string_agg(trim(line), ' / ' ORDER BY line_no) FILTER (WHERE r <= 3) AS heads FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS r FROM md WHERE starts_with(line, '# ')) GROUP BY doc)"
PAGE = "(SELECT *, coalesce(lag(line) OVER w, '') AS p, coalesce(lead(line) OVER w, '') AS x FROM md WINDOW w AS (PARTITION BY doc ORDER BY line_no))"
TOKENS = "|".join(rules.GLUED_TOKENS)
GLUED = f"""(SELECT doc, line_no, line, i, ws[i] AS m, ps[i] AS before, ps[i + 1] AS after, right(array_to_string(list_transform(list_zip(ps[1:i], list_append(ws[1:i - 1], '')), lambda z: z[1] || z[2]), ''), 20) || ws[i] || left(array_to_string(list_transform(list_zip(ps[i + 1:], list_append(ws[i + 1:], '')), lambda z: z[1] || z[2]), ''), 20) AS win
  FROM (SELECT *, unnest(generate_series(1, len(ws))) AS i FROM (SELECT *, string_split_regex(line, '{N}+') AS ps, regexp_extract_all(line, '{N}+') AS ws FROM md)))"""

DETECT = {
    "slurm_directive_heading": _md("slurm_directive_heading", "error", "'shell/SLURM directive will render as a top-level heading'", "rtrim(line)", "NOT in_fence AND regexp_matches(line, '^(#SBATCH\\s|#PBS\\s|#!\\s*/)')", TICKS),
    "code_fence_false_positive": _md("code_fence_false_positive", "info", "'fenced block (len=' || n || ') reads as prose'", "substr(body, 1, 160)", f"n BETWEEN 1 AND 4 AND body <> '' AND NOT regexp_matches(body, '[={{}};<>]|(^|[^{N[1:-1]}])(function|def|class)($|[^{N[1:-1]}])') AND len(regexp_extract_all(body, '[A-Za-z]{{2,}}')) >= 3", BLOCKS),
    "code_fence_missing": _md("code_fence_missing", "warn", "'inline backtick span is ' || (length(m) - 2) || ' chars'", "substr(m, 1, 160) || CASE WHEN length(m) > 160 THEN '...' ELSE '' END", "TRUE", _each("`[^`\\n]{200,}`"))
    + " UNION ALL " + _md("code_fence_missing", "warn", "'inline backtick span spans ' || (nr - r + 1) || ' lines'", "substr(rtrim(line), 1, 160)", "NOT mk AND NOT in_fence AND (length(line) - length(replace(line, '`', ''))) % 2 = 1 AND nr IS NOT NULL", NEAR),
    "external_image_link": _md("external_image_link", "error", "'image src is a remote URL, not a local artifact'", "substr(m, 1, 160)", "TRUE", _each(r"!\[[^\]]*\]\(https?://[^)\s]+\)")),
    "nested_bracket_unresolved_link": _md("nested_bracket_unresolved_link", "error", "'nested-bracket link is still relative'", "substr(m, 1, 160)", "TRUE", _each(r"\[\s*\[[^\]]+\][^\]]*\]\((?:\.{0,2}/[^)\s]+|[A-Za-z0-9_\-]+\.html[^)\s]*)\)")),
    "mojibake": _md("mojibake", "warn", "'mojibake sequence ''' || p || ''' present'", "rtrim(substr(line, greatest(1, instr(line, p) - 20), instr(line, p) + 40 - greatest(1, instr(line, p) - 20)))", "p IS NOT NULL", f"(SELECT *, {FOUND} AS p FROM md)"),
    "orphan_page_number": _md("orphan_page_number", "warn", "'bare digit line with blank neighbours'", "rtrim(line)", "regexp_matches(line, '^\\s*\\d{1,3}\\s*$') AND trim(p) = '' AND trim(x) = ''", PAGE),
    "listing_page_contamination": _md("listing_page_contamination", "warn", "n || ' consecutive dotted-leader lines'", "substr(rtrim(line), 1, 160)", "n >= 5", RUNS),
    "hyphen_break_artifact": _md("hyphen_break_artifact", "warn", "'line-broken compound ''' || j || ''' not re-joined'", "substr(trim(line), 1, 160)", f"j IN {_in(rules.BROKEN_COMPOUNDS)}", f"(SELECT *, lower(regexp_replace(m, '-\\s+', '-')) AS j FROM {_each('[A-Za-z]+-\\s+[a-z]+')})"),
    "compound_unglue_regression": _md("compound_unglue_regression", "warn", "'glued compound ''' || m || ''' in prose'", "substr(trim(line), 1, 160)", f"m IN {_in(rules.GLUED_TOKENS)} AND right(before, 1) NOT IN ('/', chr(92), '.', '-') AND left(after, 1) NOT IN ('/', chr(92), '.', '-') AND NOT contains(win, '://') AND NOT contains(win, '/' || m) AND NOT contains(win, m || '/')", GLUED),
    "h1_explosion": _md("h1_explosion", "warn", "n || ' H1 headings (threshold 8)'", "substr(heads, 1, 200)", "n > 8", H1S, extra="'{\"count\":' || n || ',\"threshold\":8}'"),
    "bullet_as_heading": _md("bullet_as_heading", "error", "'heading is a bare bullet glyph'", "rtrim(line)", "regexp_matches(line, '^#{1,6}\\s+[·•●▪◦・]\\s*$')"),
    "empty_heading": _md("empty_heading", "error", "CASE WHEN regexp_matches(line, '^#+\\s*$') THEN 'heading has no text' ELSE 'heading contains only punctuation/bullet glyphs' END", "coalesce(nullif(rtrim(line), ''), '(empty)')", "regexp_matches(line, '^#+\\s*$') OR (regexp_matches(line, '^#+\\s+[^\\p{L}\\p{N}]+\\s*$'))"),
    "url_backslash": _md("url_backslash", "error", "'backslash inside http(s) URL'", "substr(m, 1, 160)", "TRUE", _each(r"https?://[^\s)]*\\[^\s)]*")),
}

NONE = "CAST(NULL AS INT)"
TARGET = """(SELECT *, CASE WHEN split_part(href, '#', 1) = '' THEN member ELSE regexp_replace(split_part(href, '#', 1), '^(\\./)+', '') END AS target, substr(href, instr(href, '#') + 1) AS frag
  FROM hrefs WHERE NOT contains(href, '://') AND regexp_matches(href, '#.'))"""


def _fact(name, severity, message, snippet, source, where="TRUE", file="member", line="line", extra="CAST(NULL AS VARCHAR)"):
    return f"{_select(name, severity, message, snippet, file, line, extra)} FROM {source} WHERE {where}"


FIRST = "(SELECT book, text, member, min_by(level, line) AS level FROM headings GROUP BY book, text, member)"
LEVELS = f"(SELECT book, text, level, count(*) AS k, min(member) AS m FROM {FIRST} GROUP BY book, text, level)"
TOP = f"(SELECT book, text, sum(k)::BIGINT AS n, min(m) AS member, first(level ORDER BY k DESC, m, level) AS top FROM {LEVELS} GROUP BY book, text)"
EPUB = {
    "invalid_id": _fact("invalid_id", "'error'", "'id ''' || id || ''' is not a valid HTML id'", "id", "ids", "NOT regexp_matches(id, '^[A-Za-z_][A-Za-z0-9_\\-:.]*$')"),
    "duplicate_id": _fact("duplicate_id", "'error'", "'id ''' || id || ''' appears ' || n || ' times in ' || files || ' file(s)'", "id", "(SELECT book, id, count(*) AS n, count(DISTINCT member) AS files, min(member) AS member, min_by(line, member) AS line FROM ids GROUP BY book, id)", "n > 1"),
    "broken_internal_anchor": _fact("broken_internal_anchor", "'warn'", "'anchor target file ''' || target || ''' not in EPUB'", "substr(href, 1, 160)", f"{TARGET} t", "NOT EXISTS (SELECT 1 FROM members m WHERE m.book = t.book AND m.member = t.target)")
    + " UNION ALL " + _fact("broken_internal_anchor", "'error'", "'fragment #' || frag || ' not found in ' || target", "substr(href, 1, 160)", f"{TARGET} t", "EXISTS (SELECT 1 FROM members m WHERE m.book = t.book AND m.member = t.target) AND NOT EXISTS (SELECT 1 FROM ids i WHERE i.book = t.book AND i.member = t.target AND i.id = t.frag)"),
    "relative_href_skeleton": _fact("relative_href_skeleton", "'warn'", "'href is a relative .html skeleton'", "substr(href, 1, 160)", "hrefs", "regexp_matches(href, '^\\.{0,2}/[A-Za-z0-9_\\-]+\\.html(?:[#?].*)?$')"),
    "heading_depth_jump": _fact("heading_depth_jump", "CASE WHEN level - p - 1 >= 3 THEN 'warn' ELSE 'info' END", "'H' || p || ' → H' || level || ' skips ' || (level - p - 1) || ' levels'", "text", "(SELECT *, lag(level) OVER (PARTITION BY book, member ORDER BY line) AS p FROM headings)", "level - p - 1 > 1", extra="'{\"from\":' || p || ',\"to\":' || level || ',\"skipped\":' || (level - p - 1) || '}'"),
    "empty_spine_item": _fact("empty_spine_item", "'warn'", "'spine item has no body text'", "CAST(NULL AS VARCHAR)", "body_stats", "body_len = 0 AND NOT regexp_matches(member, '(?i)nav|toc|cover|titlepage|copyright')", line=NONE),
    "image_alt_empty": _fact("image_alt_empty", "'warn'", "CASE WHEN alt IS NULL THEN 'img has no alt attribute' ELSE 'img has empty alt=\"\"' END", "src", "images", "coalesce(alt, '') = '' AND coalesce(lower(role), '') NOT IN ('presentation', 'none') AND NOT regexp_matches(src, '(?i)(?:^|/)icons?/|[-_]icon\\.[a-z]+$')", extra="'{\"src\":\"' || src || '\",\"alt_missing\":' || CASE WHEN alt IS NULL THEN 'true' ELSE 'false' END || '}'"),
    "heading_text_duplication": _fact("heading_text_duplication", "'info'", "'heading ''' || text || ''' appears in ' || n || ' files'", "text", TOP, f"n >= 2 AND text NOT IN {_in(rules.COMMON_HEADINGS)}", line=NONE, extra="'{\"level\":' || top || '}'"),
    "external_href_density": _fact("external_href_density", "'warn'", "n || ' external hrefs (threshold 50)'", "CAST(NULL AS VARCHAR)", "(SELECT book, member, count(*) FILTER (WHERE regexp_matches(href, '(?i)^https?://')) AS n FROM hrefs GROUP BY book, member)", "n > 50", line=NONE, extra="'{\"count\":' || n || ',\"threshold\":50}'"),
    "opf_manifest_spine_consistency": " UNION ALL ".join([
        _fact("opf_manifest_spine_consistency", "'error'", "'broken spine idref ''' || idref || ''''", "idref", "spine s", "NOT EXISTS (SELECT 1 FROM manifest m WHERE m.book = s.book AND m.id = s.idref)", "'content.opf'", NONE, "'{\"kind\":\"broken_spine\"}'"),
        _fact("opf_manifest_spine_consistency", "'error'", "'manifest href ''' || href || ''' missing from zip'", "href", "manifest m", "NOT EXISTS (SELECT 1 FROM members x WHERE x.book = m.book AND x.member = m.href)", "'content.opf'", NONE, "'{\"kind\":\"missing_manifest_target\",\"id\":\"' || id || '\"}'"),
        _fact("opf_manifest_spine_consistency", "'error'", "'orphan zip file ''' || member || ''' not in manifest'", "member", "members x", "NOT EXISTS (SELECT 1 FROM manifest m WHERE m.book = x.book AND m.href = x.member)", "member", NONE, "'{\"kind\":\"orphan_file\"}'"),
    ]),
}

for name in A.MD:
    QUERIES[name] = lambda s, d, f=A.MD[name]: f(md_lines(s, d))
    SQL[name] = f"WITH {DUCK_LINES} {DETECT[name]}"
for name in A.EPUB:
    QUERIES[name] = lambda s, d, f=A.EPUB[name]: f(tables(s, d))
    SQL[name] = f"WITH {duck_facts(*TABLES[1:])} {EPUB[name]}"

ALL = f"WITH {DUCK_LINES}, {duck_facts(*TABLES[1:])}, findings AS ({' UNION ALL '.join([*DETECT.values(), *EPUB.values()])})"


def findings(spark, sf_dir, only=None):
    return A.audit(md_lines(spark, sf_dir), tables(spark, sf_dir), only)


QUERIES["run_all"] = findings
SQL["run_all"] = f"{ALL} SELECT * FROM findings"
QUERIES["only_filter"] = lambda s, d: findings(s, d, ["mojibake", "h1_explosion", "invalid_id", "no_such_detector"])
SQL["only_filter"] = f"{ALL} SELECT * FROM findings WHERE detector IN ('mojibake', 'h1_explosion', 'invalid_id', 'no_such_detector')"
QUERIES["exit_code"] = lambda s, d: A.exit_code(findings(s, d))
SQL["exit_code"] = f"{ALL} SELECT CAST(coalesce(max(CASE severity WHEN 'error' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END), 0) AS INT) AS exit_code FROM findings"
QUERIES["report_md"] = lambda s, d: R.totals(findings(s, d))
SQL["report_md"] = f"{ALL} SELECT detector, count(*) AS n, count(*) FILTER (WHERE severity = 'error') AS error, count(*) FILTER (WHERE severity = 'warn') AS warn, count(*) FILTER (WHERE severity = 'info') AS info, '## `' || detector || '` — ' || count(*) || ' finding(s)' AS heading FROM findings GROUP BY detector"
QUERIES["report_text"] = lambda s, d: R.text_lines(findings(s, d))
SQL["report_text"] = f"{ALL} SELECT detector, file, line, '[' || rpad(upper(severity), 5, ' ') || '] ' || detector || ' @ ' || coalesce(file, '?') || coalesce(':' || line, '') || ' — ' || message || CASE WHEN coalesce(snippet, '') <> '' THEN chr(10) || '    | ' || replace(snippet, chr(10), chr(10) || '    | ') ELSE '' END AS report FROM findings"
QUERIES["report_json"] = lambda s, d: R.json_rows(findings(s, d))
FIELD = lambda name, x: f"CASE WHEN {x} IS NULL THEN '' ELSE ',\"{name}\":' || to_json({x}) END"
ROW = "'{\"detector\":' || to_json(detector) || " + " || ".join(FIELD(n, n) for n in ("severity", "file", "line", "message", "snippet", "extra")) + " || '}'"
ORDER = ", ".join(f"{n} NULLS FIRST" for n in ("detector", "severity", "file", "line", "message", "snippet", "extra"))
SQL["report_json"] = f"{ALL} SELECT file, '[' || string_agg({ROW}, ',' ORDER BY {ORDER}) || ']' AS json FROM findings GROUP BY file"
QUERIES["detector_catalog"] = lambda s, d: R.catalogue(s)
SQL["detector_catalog"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', '{k}', '{_q(t)}', '  - {n}: {_q(t)}')" for i, (n, k, t) in enumerate(rules.DETECTORS)) + ") AS v(ord, detector, kind, description, entry)"
# metadata and page templates, over the pages table
PAGES = lambda s, d: s.read.parquet(f"{d}/pages.parquet")
TITLE = lambda: F.regexp_extract("html", "<h1>(.*?)</h1>", 1)
QUERIES["xhtml_wrap"] = lambda s, d: PAGES(s, d).select("page_id", R.xhtml_page(F.lit("<p>x</p>"), TITLE(), F.lit("en")).alias("page"))
H1 = "regexp_replace(substr(trim(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '<[^>]+>', '', 'g')), 1, 120), '^$', 'Chapter')"
SQL["xhtml_wrap"] = f"""SELECT page_id, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<!DOCTYPE html>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" xml:lang="en">' || chr(10) || '  <head>' || chr(10) || '    <meta charset="utf-8"/>' || chr(10) || '    <title>' ||
replace(replace(replace({H1}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title>' || chr(10) || '    <link rel="stylesheet" type="text/css" href="epub.css"/>' || chr(10) || '  </head>' || chr(10) || '  <body>' || chr(10) || '<p>x</p>' || chr(10) || '  </body>' || chr(10) || '</html>' || chr(10) AS page FROM pages"""
META = lambda: (TITLE(), F.lit("Ann & Bob, Cy and Di"), F.lit("en"), F.lit('Press "X"'), F.lit("a, b,,c"), F.lit("engine"))
QUERIES["opf_render"] = lambda s, d: PAGES(s, d).select("page_id", R.opf_metadata(*META(), F.concat(F.lit("urn:x:"), F.col("page_id"))).alias("opf"))
QUERIES["metadata_yaml"] = lambda s, d: PAGES(s, d).select("page_id", R.metadata_yaml(*META()).alias("yaml"))
T = "regexp_extract(html, '<h1>(.*?)</h1>', 1)"
X = f"replace(replace(replace(coalesce(nullif({T}, ''), 'Untitled'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
SQL["opf_render"] = f"""SELECT page_id, array_to_string(['<dc:identifier id="bookid">urn:x:' || page_id || '</dc:identifier>', '<dc:title>' || {X} || '</dc:title>', '<dc:language>en</dc:language>', '<dc:creator>Ann</dc:creator>', '<dc:creator>Bob, Cy and Di</dc:creator>',
'<dc:publisher>Press "X"</dc:publisher>', '<dc:subject>a</dc:subject>', '<dc:subject>b</dc:subject>', '<dc:subject>c</dc:subject>', '<dc:contributor>engine</dc:contributor>', '<meta property="dcterms:modified">1970-01-01T00:00:00Z</meta>'], chr(10) || '    ') AS opf FROM pages"""
QY = f"'\"' || replace(replace({T}, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"') || '\"'"
SQL["metadata_yaml"] = f"""SELECT page_id, '---' || chr(10) || CASE WHEN {T} <> '' THEN 'title: ' || {QY} || chr(10) ELSE '' END || 'creator:' || chr(10) || array_to_string(list_transform(['Ann', 'Bob', 'Cy', 'Di'], lambda a: '  - role: author' || chr(10) || '    text: "' || a || '"'), chr(10)) || chr(10) || 'lang: "en"' || chr(10) ||
'publisher: "Press ' || chr(92) || '"X' || chr(92) || '""' || chr(10) || 'subject:' || chr(10) || '  - "a"' || chr(10) || '  - "b"' || chr(10) || '  - "c"' || chr(10) || 'contributor:' || chr(10) || '  - role: bkp' || chr(10) || '    text: "engine"' || chr(10) || '---' || chr(10) AS yaml FROM pages"""
