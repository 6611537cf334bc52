import random
import re
import time

import pytest

from inkloom.functions import rules
from inkloom.operators import lines as L
from inkloom.operators import tidy as T


def test_contents_table_goes_but_prose_contents_stays(lines, text_of):
    out = T.strip_toc(lines("## Contents\n\n| a | 1 |\n7\n| b | 2 |\nbody\n# Table of Contents\nwords here"))
    assert text_of(out) == ["body", "# Table of Contents", "words here"]


def test_contents_followed_by_a_number_stays(lines, text_of):
    text = "## Contents\n12\n| a |\nx"
    assert text_of(T.strip_toc(lines(text))) == text.split("\n")


def test_dividers_dashes_and_numbers(lines, text_of):
    assert text_of(T.strip_chunk_dividers(lines("a\n --- \nb"))) == ["a", "b"]
    assert text_of(T.strip_orphan_dashes(lines("a\n-\n- b"))) == ["a", "- b"]
    assert text_of(T.strip_page_numbers(lines("12\n\n345\n\nx\n6\n\n99999\n"))) == ["", "", "x", "6", "", "99999", ""]


def test_title(lines, text_of):
    text = "intro\n## The Well-Architected Framework guide\nx\n## Well Architected Framework"
    assert text_of(T.consolidate_title(lines(text))) == ["intro", "# The Well-Architected Framework guide", "x"]
    assert text_of(T.consolidate_title(lines("a\nb"), "Book")) == ["# Book", "", "a", "b"]


def test_heading_rules(lines, text_of):
    out = T.demote_subsections(lines("## • Point \n## FSIOPS1-BP2 Do\n## FSISEC3: Why?\n#### Benefits\n## Videos\n## Other"))
    assert text_of(out) == ["- **Point**", "#### FSIOPS1-BP2 Do", "### FSISEC3: Why?", "##### Benefits", "### Videos", "## Other"]
    assert text_of(T.promote_pillars(lines("## Security\n## Safety"))) == ["# Security", "## Safety"]
    assert text_of(T.indent_lettered(lines("- a. x\n- A. x"))) == ["  - a. x", "- A. x"]


def test_list_gaps(lines, text_of):
    assert text_of(T.heal_list_gaps(lines("\n- a\n\n\n- b\n\n  - c\n\n1. d\n"))) == ["", "- a", "- b", "", "  - c", "", "1. d", ""]


@pytest.mark.parametrize(("given", "wanted"), [("real- time", "real-time"), ("over- or under- use", "over- or under-use"), ("a- b", "a- b"), ("x- éa", "x- éa"), ("pre- the end", "pre- the end")])
def test_hyphens(lines, text_of, given, wanted):
    assert text_of(T.heal_hyphens(lines(given))) == [wanted]


def test_sentences_join_every_other_edge(lines, text_of):
    assert text_of(T.heal_sentences(lines("one\n\ntwo\n\nthree\n\nfour"))) == ["one two", "", "three four"]
    assert text_of(T.heal_sentences(lines("End.\n\nnext\n\n- item\n\n# head\n\ntail"))) == ["End.", "", "next", "", "- item", "", "# head", "", "tail"]


def sequential_sentences(rows):
    """The greedy scan that the closed form stands for."""
    item, out, i = re.compile(r"(\s*)([-*+]|\d+[.)])\s+"), [], 0
    marked = lambda x: x.lstrip().startswith(("#", "|", ">", "```", "!["))
    while i < len(rows):
        j = i + 1
        while j < len(rows) and not rows[j].strip():
            j += 1
        ok = rows[i].strip() and not marked(rows[i]) and not rows[i].rstrip().endswith(tuple(rules.SENTENCE_ENDS)) and i + 1 < j < len(rows)
        if ok and rows[j][0].islower() and not marked(rows[j]) and not item.match(rows[j]):
            out.append(rows[i].rstrip() + " " + rows[j].lstrip())
            i = j + 1
        else:
            out.append(rows[i])
            i += 1
    return out


def test_sentences_agree_with_a_scan(lines, text_of):
    rng = random.Random(7)
    texts = ["\n".join(rng.choice(["", "", "", "ab", "cd", "Cd", "ef.", "- x", "# h", "| t", "g:", " zz"]) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    out = T.heal_sentences(lines(*texts)).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["doc"], r["line_no"])):
        got.setdefault(r["doc"], []).append(r["line"])
    for i, t in enumerate(texts):
        assert got.get(i, []) == sequential_sentences(t.split("\n")), t


def test_digit_headings(lines, text_of):
    out = T.fix_digit_headings(lines("## 3. Do it:\n## 4 Run\n# 24×7 care.\n## ·\n## -- **\n## Fine"))
    assert text_of(out) == ["## Step 3: Do it", "## Step 4: Run", "# Ref. 24×7 care", "## Fine"]
    assert text_of(T.fix_digit_headings(lines("## 1.1 Foo\n## •"), "generic")) == ["## 1.1 Foo"]


def test_words(lines, text_of):
    assert text_of(T.unglue_compounds(lines("a realtime x.com/realtime/ realtime. longterm"))) == ["a real-time x.com/realtime/ realtime. long-term"]
    assert text_of(T.heal_spaces(lines("the architect ural component s"))) == ["the architectural components"]


@pytest.mark.parametrize(("given", "wanted"), [("**A ** is", "**A** is"), ("** A ** and ** B**", "**A** and **B**"), ("__ x __", "__x__"), ("**  **", "**  **"), ("**ok** a **b**", "**ok** a **b**")])
def test_emphasis(lines, text_of, given, wanted):
    assert text_of(T.strip_emphasis_space(lines(given))) == [wanted]


def test_seams_links_and_images(lines, text_of):
    assert text_of(T.space_adjacency(lines("a[b](c)d **e**f __g__h"))) == ["a [b](c) d **e** f __g__ h"]
    assert text_of(T.strip_image_alt(lines("![Image](a)\n```\n![Image](a)\n```\n![ image ](b)"))) == ["![](a)", "```", "![Image](a)", "```", "![](b)"]
    out = T.absolute_links(lines(r"[a](./x.html) ![i](./y) [b](c\d) [e](#f) [[X.1] g](../h)"), "B/")
    assert text_of(out) == ["[a](B/x.html) ![i](./y) [b](B/c/d) [e](#f) [[X.1] g](B/../h)"]


def test_math(lines, text_of):
    assert text_of(T.wrap_aligned(lines(r"$$a & b$$ $$c$$ $$\begin{x}&\end{x}$$"))) == [r"$$\begin{aligned}a & b\end{aligned}$$ $$c$$ $$\begin{x}&\end{x}$$"]
    assert text_of(T.escape_dollars(lines("$5 `$x` $$m$$ \\$ $"))) == ["\\$5 `$x` $$m$$ \\$ \\$"]


BOOK = "## 01\n\n## INTRODUCTION\n## 1.1 One\n## 1.1.1 Deep\n## Aside\n## 1.2 Two\n## EXERCISES\n## NEXT TOPIC\n## 2.1 Three\n## 2.2 Four\n```\n## 9.9 code\n```"


def test_numbered_chapters(lines, text_of):
    assert text_of(T.number_chapters(lines(BOOK))) == [
        "# 1 INTRODUCTION", "## 1.1 One", "### 1.1.1 Deep", "#### Aside", "## 1.2 Two", "## EXERCISES", "# 2 NEXT TOPIC", "## 2.1 Three", "## 2.2 Four", "```", "## 9.9 code", "```",
    ]
    few = "## 1.1 A\n## 1.2 B\n## X"
    assert text_of(T.number_chapters(lines(few))) == few.split("\n")


def test_chapter_number_takes_half_a_title(lines, text_of):
    text = "## 08 FAULT\n## TOLERANCE\n## 8.1 A\n## 8.2 B\n## 9.1 C\n## 9.2 D"
    assert text_of(T.number_chapters(lines(text)))[0] == "# 8 FAULT TOLERANCE"


def test_book_title_is_not_a_chapter(lines, text_of):
    assert "## MY BOOK" not in text_of(T.number_chapters(lines("## MY BOOK\n" + BOOK), "My Book"))


def test_whole_tidy(lines, text_of):
    out = T.tidy(lines("## Contents\n| a | 1 |\n\n## Security\n- a. one\n\n- b. two\n\nThe real- time plan\n\nfor wellarchitected work[x](./y.html)now"))
    assert text_of(out) == ["# Security", "  - a. one", "  - b. two", "", "The real-time plan for well-architected work [x](https://docs.aws.amazon.com/y.html) now"]


def test_tidy_shuffles_once(lines):
    plan = T.tidy(lines("a\nb"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1


def test_lines_round_trip(spark):
    docs = spark.createDataFrame([(1, "a\r\nb\n"), (2, ""), (3, None), (4, "x\n\ny")], "doc bigint, text string")
    got = [(r["doc"], r["line"]) for r in L.to_lines(docs).orderBy("doc", "line_no").collect()]
    assert got == [(1, "a"), (1, "b"), (4, "x"), (4, ""), (4, "y")]
    assert {r["doc"]: r["text"] for r in L.to_text(L.to_lines(docs)).collect()} == {1: "a\nb\n", 4: "x\n\ny\n"}


def test_fences(lines):
    rows = L.tick_fence_state(L.fence_state(L.fence_mask(lines("a\n```\nb\n~~~\nc")))).orderBy("line_no").collect()
    assert [r["fenced"] for r in rows] == [False, True, True, True, False]


def test_marks_of_any_kind_survive_rewriting(lines, text_of):
    assert text_of(T.escape_dollars(lines("price \x01$5 and $6\n$$a$$ `$x` \x01"))) == ["price \x01\\$5 and \\$6", "$$a$$ `$x` \x01"]
    assert text_of(T.unglue_compounds(lines("\x01realtime\x01 plan realtime"))) == ["\x01real-time\x01 plan real-time"]


def test_a_long_document_takes_time_in_proportion(spark):
    lines = spark.range(40_000).selectExpr("0 AS doc", "id AS line_no", "CASE id % 4 WHEN 0 THEN concat('- item ', id) WHEN 1 THEN '' WHEN 2 THEN 'an open line' ELSE concat('## ', id % 9, '.', id % 5, ' x') END AS line")
    for step in (T.heal_list_gaps, T.heal_sentences, T.number_chapters):
        begun = time.time()
        assert step(lines).count() > 0
        assert time.time() - begun < 10
