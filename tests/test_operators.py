import zipfile

import pytest
from pyspark.sql import functions as F

from inkloom.operators import align, audit, chunking, formula, links, refs, report
from inkloom.functions import markdown
from inkloom.plans import registry
from inkloom.sources import archives, pages


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_detectors_find_and_spare(lines):
    text = "\n".join(["#SBATCH -n 1", "```", "#SBATCH x", "```", "![a](http://x/y.png)", "[[A.1] b](./c.html)", "cafÃ©", "", "7", "", "real- time", "a realtime b", "see /realtime/", "## •", "##", "http://a\\b"])
    found = {r["detector"]: r for r in audit.audit(lines(text)).collect()}
    assert set(found) == {"slurm_directive_heading", "external_image_link", "nested_bracket_unresolved_link", "mojibake", "orphan_page_number", "hyphen_break_artifact", "compound_unglue_regression", "bullet_as_heading", "empty_heading", "url_backslash"}
    assert found["slurm_directive_heading"]["line"] == 1
    assert audit.exit_code(audit.audit(lines(text))).first()[0] == 2


def test_prose_in_a_fence_and_missing_fences(lines):
    found = values(audit.audit(lines("```\nthis is just prose\n```\nan `open\nclosed` here\n`" + "x" * 210 + "`")), "detector", "line", "message")
    assert found == [
        ("code_fence_false_positive", 1, "fenced block (len=1) reads as prose"), ("code_fence_missing", 4, "inline backtick span spans 2 lines"),
        ("code_fence_missing", 5, "inline backtick span spans 2 lines"), ("code_fence_missing", 6, "inline backtick span is 210 chars"),
    ]


def test_listing_and_headings(lines):
    text = "\n".join([f"p{i} ...... {i}" for i in range(5)] + ["x"] + [f"# h{i}" for i in range(9)])
    assert values(audit.audit(lines(text)), "detector", "line", "message") == [("h1_explosion", 7, "9 H1 headings (threshold 8)"), ("listing_page_contamination", 1, "5 consecutive dotted-leader lines")]


def test_path_variants(spark):
    one = lambda up: spark.range(1).select(audit.resolved(F.lit("a"), F.lit("../../b/./c"), up)).first()[0]
    assert (one(False), one(True)) == ("b/c", "../b/c")


def test_reports(spark):
    found = spark.createDataFrame([("d", "warn", "f", 3, "m", "s1\ns2", None), ("d", "error", None, None, "n", None, None)], audit.SCHEMA)
    assert values(report.text_lines(found), "report") == [("[ERROR] d @ ? — n",), ("[WARN ] d @ f:3 — m\n    | s1\n    | s2",)]
    assert values(report.totals(found), "n", "error", "warn", "info") == [(2, 1, 1, 0)]


@pytest.mark.parametrize(
    ("href", "wanted"),
    [("./x", "https://h/a/x"), ("../y", "https://h/y"), ("/z", "https://h/z"), ("#f", "https://h/a/b?q#f"), ("?k", "https://h/a/b?k"), ("//o/p", "https://o/p"), ("ftp://q", "ftp://q"), ("../../r/..", "https://h/"), ("", "https://h/a/b?q")],
)
def test_url_join(spark, href, wanted):
    assert spark.range(1).select(links.url_join(F.lit("https://h/a/b?q"), F.lit(href))).first()[0] == wanted


def test_links_come_back_once_a_line(spark, lines, text_of):
    pairs = spark.createDataFrame([(1, "Design Guide", "u1"), (2, "Design Guide for teams", "http://u2"), (3, "here", "u3"), (4, "resources", "http://u4")], "seq bigint, text string, uri string")
    out = links.restore_links(lines("Our design  guide, and Design Guide for teams\nhas [a](b) Design Guide\nhere\n" + "resources " * 4), links.clean_annotations(pairs, "B/"))
    assert text_of(out) == ["Our [design  guide](B/u1), and Design Guide for teams", "has [a](b) Design Guide", "here", "resources " * 4]
    plan = links.restore_links(lines("x"), pairs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_first_address_wins(spark):
    pairs = spark.createDataFrame([(2, "a b", "y"), (1, "a b", "x")], "seq bigint, text string, uri string")
    assert values(links.first_uri(pairs), "text", "uri", "n") == [("a b", "x", 2)]


def test_article_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(refs.repair_encoding(F.lit("cafÃ© â€™ ï¬ow"))) == "cafÃ© â€™ flow".replace("Ã©", "é").replace("â€™", "’")
    assert one(refs.repair_encoding(F.lit("â 日"))) == "â 日"
    assert one(refs.escape_placeholders(F.lit("`<a>` <b c> <d>"))) == "`&lt;a&gt;` &lt;b c&gt; <d>"
    assert one(refs.fence_inline_code(F.lit("a `x\ny` b `k: 1\nz`"))) == "a x\ny b \n\n```\nk: 1\nz\n```\n\n"
    assert one(refs.escape_directives(F.lit("#SBATCH a\nb"))) == "\\#SBATCH a\nb"


def test_tables(lines, text_of):
    assert text_of(refs.repair_tables(lines("| a | b |\n| c |\n| - |\n| d |\n|\n| e |"))) == ["a — b", "| c |", "| - |", "| d |", "e"]


def test_appendix(spark, lines, text_of):
    articles = spark.createDataFrame([(0, 1, "T", "https://u", "# H\n-\nx")], "doc int, ord int, title string, url string, content string")
    out = refs.with_appendix(lines("body"), articles, "generic")
    assert text_of(out)[:2] == ["body", ""] and "## T {#ref-0001}" in text_of(out) and "### H" in text_of(out) and "-" not in text_of(out)


def test_chunks_pack_under_budget(lines):
    out = chunking.pack_sections(lines("pre\n# A\n## a\nxxxx\n## b\nyyyy\n```\n# no\n```\n# B\nz"), 20)
    assert [r["text"] for r in out.orderBy("chapter", "part").collect()] == ["pre\n", "# A\n## a\nxxxx\n", "## b\nyyyy\n```\n# no\n```\n", "# B\nz\n"]


def test_ids(spark):
    ids = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "c", "x"), (1, "c", "x-1"), (1, "a", "y")], "book int, member string, id string")
    assert values(chunking.unique_ids(ids).where("id = 'x'"), "member", "new_id") == [("a", "x"), ("b", "x-2"), ("c", "x-3")]
    hrefs = spark.createDataFrame([(1, "a", 1, "b#x"), (1, "b", 2, "#x"), (1, "a", 3, "a#x")], "book int, member string, line int, href string")
    assert values(chunking.rewrite_hrefs(hrefs, chunking.unique_ids(ids)), "line", "href") == [(1, "b#x-2"), (2, "#x-2"), (3, "a#x")]


def test_heading_ids(lines):
    got = chunking.heading_ids(lines("# A {#one}\n```\n# B {#two}\n```\n## C")).where("ord IS NOT NULL").orderBy("ord").collect()
    assert [(r["line"], r["id"]) for r in got] == [("# A", "one"), ("## C", None)]


def test_formulas(spark, lines, text_of):
    boxes = spark.createDataFrame([(0, 0, 1.0, 1.0, 0, 0, 5, 5), (0, 1, 1.0, 1.0, 0, 0, 5, 5), (0, 2, 1.0, 1.0, 3, 0, 3, 5)], "doc int, ord int, page_w double, page_h double, left int, top int, right int, bottom int")
    out = formula.image_fallback(lines("$$a & b$$ `$$c$$` $$ok$$\n$$x & y$$ $$p & q$$"), boxes)
    assert text_of(out) == ["![](media/formula_0000.png) `$$c$$` $$ok$$", "$$x & y$$ $$p & q$$"]


def test_anchors(spark):
    pick = lambda t: spark.range(1).select(align.pick_anchor(F.lit(t))).first()[0]
    long = " ".join(f"w{i}" for i in range(14))
    assert pick("12\nshort line\n" + long) == " ".join(f"w{i}" for i in range(12))
    assert pick("a b c\nd e f g h") == "a b c d e f g h" and pick("a b") == ""
    pages_ = spark.createDataFrame([(1, 0, long), (1, 1, "x y")], "book int, page_no int, text string")
    blocks = spark.createDataFrame([(1, "m2", 0, "q"), (1, "m1", 0, "no"), (1, "m1", 1, " ".join(f"W{i}" for i in range(9)))], "book int, member string, block int, text string")
    assert values(align.sample(pages_, blocks), "page_no", "member", "para_start", "para_end") == [(0, "m1", 0, 2), (1, "", 0, 0)]


def test_replies(spark):
    replies = spark.createDataFrame([(1, 'x ```json\n{"findings":[{"severity":"warn"},3]}\n```'), (2, "{bad"), (3, ""), (4, "[]")], "chunk int, reply string")
    got = values(align.parse_reply(replies), "chunk", "severity", "type")
    assert got == [(1, "warn", "unknown"), (2, "info", "parse_error")]


def test_html_facts(spark):
    df = spark.createDataFrame([(1, '<body><h1 id="a">T</h2><p>x<img src="s"><p>y <b>z<a href="#a">l</a></body>'), (2, None)], "page_id int, html string")
    got = {(r["page_id"], r["kind"]): (r["level"], r["value"], r["src"]) for r in pages.html_facts(df).collect()}
    assert got[1, "heading"] == (1, "T", None) and got[1, "image"] == (None, None, "s") and got[1, "href"][1] == "#a" and got[2, "body"][0] == 0
    assert values(pages.html_blocks(df), "block", "text") == [(0, "T"), (1, "x"), (2, "y zl")]


def test_a_page_is_read_beyond_odd_sections_and_long_numbers(spark):
    odd = ["<![foo[x]]>", "<![ if x]>", "<![>", f"&#{'9' * 5000};", f'<i title="&#{"9" * 5000};">', f"&#{'0' * 5000};"]
    df = spark.createDataFrame([(i, f'<body>{x}\n<h1>T</h1><a href="u">k</a><main><p>&#{"0" * 5000}65;') for i, x in enumerate(odd)], "page_id int, html string")
    want = [(i, 2, v) for i in range(len(odd)) for v in ("T", "u")]
    assert sorted((r["page_id"], r["line"], r["value"]) for r in pages.html_facts(df).where("kind <> 'body'").collect()) == want
    assert values(pages.html_blocks(df).where("main"), "page_id", "text") == [(i, "A") for i in range(len(odd))]


def test_a_fault_in_a_page_is_raised(monkeypatch):
    def fault(self, data):
        raise AssertionError(data)

    monkeypatch.setattr(pages.Facts, "handle_data", fault)
    with pytest.raises(AssertionError):
        pages.parsed('<a href="u">x</a>')


def test_archives(spark, tmp_path):
    epub = tmp_path / "b.epub"
    with zipfile.ZipFile(epub, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package xmlns="urn:y"><manifest><item id="p" href="p.xhtml"/><item id="q" href="q.xhtml"/></manifest><spine><itemref idref="p"/><itemref idref="g"/></spine></package>')
        z.writestr("o/p.xhtml", "<p>x</p>")
        z.writestr("o/z.XHTML", "<p>y</p>")
    members = archives.members(spark, str(epub))
    packages, manifest, spine = (x.withColumnRenamed("epub", "book") for x in archives.package(members))
    books = members.withColumnRenamed("epub", "book")
    found = values(audit.opf_manifest_spine_consistency(manifest, spine, books, packages), "file", "snippet")
    assert found == [("o/c.opf", "g"), ("o/c.opf", "q.xhtml"), ("o/z.XHTML", "o/z.XHTML")]
    packed = archives.repack(members).first()["content"]
    (tmp_path / "c.epub").write_bytes(bytes(packed))
    with zipfile.ZipFile(tmp_path / "c.epub") as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED


def test_archives_without_container_or_with_broken_package(spark):
    rows = [("a", "x.xhtml", b"<p>1</p>"), ("b", "META-INF/container.xml", b"<container"), ("c", "META-INF/container.xml", b'<c><rootfile full-path="o.opf"/></c>'), ("c", "o.opf", b"<package")]
    members = archives.unzipped(archives.repack(spark.createDataFrame(rows, "epub string, member string, content binary")).selectExpr("epub AS path", "content"))
    assert values(members, "epub", "member") == sorted((e, m) for e, m, _ in rows)
    packages, manifest, spine = archives.package(members)
    problems = {r["epub"]: r["problem"] for r in packages.collect()}
    assert problems["a"] == problems["b"] == "could not locate OPF rootfile" and problems["c"].startswith("OPF is not well-formed XML")
    assert manifest.count() == spine.count() == 0
    wanted = spark.createDataFrame([("a", "x.xhtml"), ("a", "gone.xhtml")], "epub string, member string")
    assert values(archives.read_member(members, wanted), "member", "html") == [("gone.xhtml", ""), ("x.xhtml", "<p>1</p>")]
    assert archives.unzipped(spark.createDataFrame([("q", b"no zip")], "path string, content binary")).count() == 0


def test_every_image_of_a_line_follows_its_own_name(spark, lines, text_of):
    text = "![](img/a.png) and ![](img/b.png), [see](img/c.png) at C:\\x y\\image_3_0aF.png and ![](http://e.com/a.png)"
    images = spark.createDataFrame([(0, n) for n in ("a.png", "c.png", "image_3_0aF.png")] + [(1, "b.png")], "doc int, name string")
    want = "![](doc_artifacts/c0000_a.png) and ![](img/b.png), [see](doc_artifacts/c0000_c.png) at doc_artifacts/c0000_image_3_0aF.png and ![](doc_artifacts/c0000_a.png)"
    assert text_of(chunking.absorb_images(lines(text + "\nno path\n$1 ](x)"), images)) == [want, "no path", "$1 ](x)"]


def test_layout_trees_of_many_levels(spark):
    nodes = [(0, "n0", None, 0)] + [(0, f"n{i}", f"n{i - 1}", 0) for i in range(1, 6)] + [(0, "last", "n5", 1), (0, "first", "n5", 0)]
    df = spark.createDataFrame([(d, n, p, k, "formula" if n in ("last", "first") else "group", "x", 1, True) for d, n, p, k in nodes], "doc int, node string, parent string, pos bigint, label string, text string, page_no int, has_box boolean")
    assert [r["node"] for r in formula.harvest(df).orderBy("ord").collect()] == ["first", "last"]
    assert formula.harvest(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="levels"):
        formula.harvest(df, depth=3)


def test_sidecars_and_build_names(spark):
    rows = [(1, '[{"page_no":2,"bbox":{"l":1,"t":2,"r":3,"b":4},"coord_origin":"TOPLEFT","page_w":5,"page_h":6,"orig":"x"},{"page_no":3}]'), (2, "no"), (3, None), (4, "[]")]
    got = formula.read_boxes(spark.createDataFrame(rows, "doc int, json string")).collect()
    assert [(r["doc"], r["ord"], r["page_no"], r["r"], r["text"]) for r in got] == [(1, 0, 2, 3.0, "x"), (1, 1, 3, None, None)]
    names = spark.createDataFrame([(s,) for s in ("a/b", " .. ", "", "x\\y ", None, ".")], "s string")
    assert [r[0] for r in names.select(chunking.build_name(names.s)).collect()] == ["a_b", None, None, "x_y", None, None]


@pytest.mark.parametrize(("text", "wanted"), [
    ("# A *b*\n\nx **y** `a<b`", "<h1>A <em>b</em></h1>\n<p>x <strong>y</strong> <code>a&lt;b</code></p>\n"),
    ("- a\n- b\n  - c", "<ul>\n<li>a</li>\n<li>b\n<ul>\n<li>c</li>\n</ul>\n</li>\n</ul>\n"),
    ("3. x\n\n4. y", '<ol start="3">\n<li>\n<p>x</p>\n</li>\n<li>\n<p>y</p>\n</li>\n</ol>\n'),
    ("| a | b |\n|---|--:|\n| 1 | ~~2~~ |", '<table>\n<thead>\n<tr>\n<th>a</th>\n<th style="text-align:right">b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1</td>\n<td style="text-align:right"><del>2</del></td>\n</tr>\n</tbody>\n</table>\n'),
    ("> q\n\n```py\nx < 1\n```", '<blockquote>\n<p>q</p>\n</blockquote>\n<pre><code class="language-py">x &lt; 1\n</code></pre>\n'),
    ('[t](u "v") ![i](j) it\'s "so"', '<p><a href="u" title="v">t</a> <img src="j" alt="i" /> it’s “so”</p>\n'),
    ("a_b_c ***d*** e \\*f* <b>g</b> &amp; &", "<p>a_b_c <em><strong>d</strong></em> e *f* <b>g</b> &amp; &amp;</p>\n"),
    ("**a ** b", "<p>**a ** b</p>\n"), ("", ""), (None, ""),
])
def test_markdown(text, wanted):
    assert markdown.to_xhtml(text) == wanted


def test_rendered_column(spark):
    got = chunking.render(spark.createDataFrame([(1, "# x"), (2, None)], "doc int, text string")).orderBy("doc").collect()
    assert [r["xhtml"] for r in got] == ["<h1>x</h1>\n", ""]


def test_fenced_code_is_whole(spark, tmp_path):
    texts = ["short", "word " * 100 + "tail"]
    spark.createDataFrame(list(enumerate(texts)), "item_id int, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["item_id"]: r["body"] for r in registry.queries()["fence_inline_code"](spark, str(tmp_path)).collect()}
    assert "short" + "x" * 225 in got[0] and "x" * 226 not in got[0]
    assert texts[1] in got[1]


def test_addresses_that_repeat_are_uncached_by_owner(spark):
    urls = spark.createDataFrame([(0, "u"), (1, "u"), (2, "v"), (3, None)], "page_id int, url string")
    cache = urls.where("page_id % 2 = 0").selectExpr("page_id", "sha1(url) AS key")
    assert {r["page_id"] for r in links.uncached(urls, cache, "page_id").collect()} == {1, 3}
    assert {r["page_id"] for r in links.uncached(urls, cache).collect()} == {3}


def test_a_member_that_stands_twice_is_an_orphan_twice(spark):
    members = spark.createDataFrame([(1, "a.xhtml"), (1, "a.xhtml"), (1, "b.xhtml")], "book int, member string")
    manifest, spine = spark.createDataFrame([(1, "b", "b.xhtml")], "book int, id string, href string"), spark.createDataFrame([(1, "b")], "book int, idref string")
    assert [r["file"] for r in audit.opf_manifest_spine_consistency(manifest, spine, members).collect()] == ["a.xhtml"] * 2


def test_headings_in_one_line_have_an_order(spark):
    rows = [(1, "m", 1, 1, "t"), (1, "m", 2, 6, "x"), (1, "m", 2, 3, "x"), (1, "n", 5, 4, "x")]
    for some in (rows, rows[::-1], [rows[i] for i in (2, 0, 3, 1)]):
        table = spark.createDataFrame(some, "book int, member string, line int, level int, text string").coalesce(1)
        assert [(r["file"], r["message"]) for r in audit.heading_depth_jump(table).collect()] == [("m", "H3 → H6 skips 2 levels")]
        assert [r["extra"] for r in audit.heading_text_duplication(table).collect()] == ['{"level":3}']


def test_of_headings_in_one_line_the_first_page_counts(spark):
    rows = [(12, 1, "m", 2, 3, "x"), (7, 1, "m", 2, 6, "x"), (5, 1, "n", 2, 4, "x"), (5, 1, "n", 1, 2, "y"), (9, 1, "n", 1, 1, "y")]
    for some in (rows, rows[::-1]):
        table = spark.createDataFrame(some, "page_id int, book int, member string, line int, level int, text string").coalesce(1)
        assert [r["extra"] for r in audit.heading_text_duplication(table).collect()] == ['{"level":6}']
        assert [r["message"] for r in audit.heading_depth_jump(table).collect()] == ["H1 → H4 skips 2 levels"]


def test_anchors_are_found_among_equal_and_common_lines(spark, monkeypatch):
    import random

    rng = random.Random(5)
    words = ["one", "two", "three", "four"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = line(12)
    blocks = [(b, f"m{m}", i, common if rng.random() < 0.3 else line(rng.randrange(1, 16))) for b in (0, 1) for m in range(6) for i in range(8)]
    anchors = [(b, p, x) for b in (0, 1) for p, x in enumerate([common, common, "", line(8), *[t[:-1] for bb, _, _, t in blocks if bb == b and len(t.split()) >= 9][:12]])]
    want = set()
    for b, p, anchor in anchors:
        ws, found = anchor.split(), []
        for bb, m, i, text in blocks:
            cuts = [n for n in range(8, len(ws) + 1) if " ".join(ws[:n]) in text]
            if bb == b and cuts:
                found.append((m, -max(cuts), i))
        if found:
            m, _, i = min(found)
            want.add((b, p, m, max(0, i - 2), min(8, i + 3)))
    monkeypatch.setattr(align, "BITMAPS", 8)
    made = align.locate(spark.createDataFrame(anchors, "book int, page_no int, anchor string"), spark.createDataFrame(blocks, "book int, member string, block int, text string"))
    assert len(want) > 20 and sorted(tuple(r) for r in made.collect()) == sorted(want)


def test_few_rows_without_an_anchors_hash_are_sent(spark):
    keys, rows = spark.range(0, 5000).selectExpr("cast(id as string) AS k"), spark.range(0, 100_000).selectExpr("cast(id as string) AS k")
    kept = {int(r["k"]) for r in rows.where(align.among(keys, "k")).collect()}
    assert kept >= set(range(5000)) and len(kept) < 5100
