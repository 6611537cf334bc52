import math
import random
import time

import numpy as np
import pytest

from inkloom.llm import extraction, graph, metric, vectors
from inkloom.llm.markup import blocks_of

VECTORS = "vec_id bigint, embedding array<float>, label int, node int, v string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], 0, 1, "c") for i, x in rows], VECTORS)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(40):
        base = rng.normal(size=24)
        for _ in range(rng.integers(1, 9)):
            rows.append((base + rng.normal(size=24) * rng.choice([0, 0.1, 0.2, 0.4])).astype("f4").tolist())
    rows += [rows[0], rows[0], None, [0.0] * 24, [1.0] * 23 + [None], [float("nan")] * 24, [1.0, 2.0], [], [float("inf")] * 24]
    return list(enumerate(rows)) + [(None, rows[1])]


def usable(x):
    return x is not None and len(x) > 0 and all(c is not None and math.isfinite(c) for c in x)


def test_near_vectors(spark, cloud, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    got = vectors.near_duplicates(vectors_of(spark, cloud)).collect()
    fine = {i: np.array(x, "f4").astype("f8") for i, x in cloud if i is not None and usable(x) and any(x)}
    near = {i: {j for j in fine if j != i and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] / np.linalg.norm(fine[i]) / np.linalg.norm(fine[j]) >= 0.95} for i in fine}
    low = {i: i for i, _ in cloud if i is not None}
    changed = True
    while changed:
        changed = False
        for i in fine:
            m = min([low[i], *(low[j] for j in near[i])])
            changed |= m < low[i]
            low[i] = m
    assert len(got) == len(cloud)
    for r in got:
        i = r["vec_id"]
        if i is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (len(near.get(i, ())), low[i], low[i] == i), i
    assert vectors.near_duplicates(vectors_of(spark, [])).count() == 0


@pytest.mark.parametrize("rotations", [2, 3, 4])
@pytest.mark.parametrize("cosine", [0.951, 0.97])
def test_buckets_find_near_pairs(rotations, cosine):
    rng = np.random.default_rng(rotations)
    x = vectors._unit(rng.normal(size=(300, 64)))
    side = rng.normal(size=x.shape)
    side = vectors._unit(side - (side * x).sum(1, keepdims=True) * x)
    y = cosine * x + math.sqrt(1 - cosine * cosine) * side
    found = np.zeros(len(x), bool)
    for table in range(8 * 2 ** (rotations - 2)):
        a, b = (vectors.buckets_of(z, table, rotations) for z in (x, y))
        found |= (a[:, :, None] == b[:, None, :]).any((1, 2))
    assert found.mean() >= 0.98


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(vectors.rotated(x, 3), axis=1), np.linalg.norm(x, axis=1))


@pytest.mark.parametrize("tree_rows", [7, 1000])
def test_top_k(spark, cloud, tree_rows):
    got = metric.top_k(vectors_of(spark, cloud), every=5, tree_rows=tree_rows, query_rows=3).collect()
    fine = {i: np.floor(256 * np.array(x, "f4").astype("f8")).astype("i8") for i, x in cloud if i is not None and usable(x)}
    want = []
    for q in (i for i in fine if i % 5 == 0):
        scores = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert metric.top_k(vectors_of(spark, [])).count() == 0


def test_rows_that_repeat_an_id_are_candidates_each(spark):
    rows = [(0, [1, 0]), (1, [2, 0]), (1, [3, 1]), (1, [3, 1]), (2, [1, 1]), (5, [0, 2]), (5, [1, 0])]
    got = metric.top_k(vectors_of(spark, rows), k=4, every=5).collect()
    want = []
    for q in (0, 5):
        scores = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(x, y)), j) for i, x in rows if i == q for j, y in rows if j != q)[:4]
        want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_tree_prunes_what_is_far():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8)) * 4000
    rows = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 20).astype("i8")
    norms = np.sqrt((rows * rows).sum(1))
    rows = (rows * (30000 / norms)[:, None]).astype("i8")
    tree = metric.MTree.unpacked(metric.MTree(np.arange(4000), rows, capacity=32).packed())
    for q in range(0, 4000, 400):
        best, computed = tree.search(rows[q], q, 5)
        s = rows @ rows[q]
        want = [(int(s[j]), int(j)) for j in np.lexsort((np.arange(4000), -s)) if j != q][:5]
        assert best == want and computed < 2500


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(30)] + [(5, 5)]
    up = {}
    for a, b in pairs:
        if a != b:
            up.setdefault(a, a), up.setdefault(b, b)
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
    want = {}
    for x in up:
        r = x
        while up[r] != r:
            r = up[r]
        want[x] = r
    got = graph.components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert {r["node"]: r["component"] for r in got.collect()} == want
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


PAGE = """<html><head><title>t</title><script>var a="</p><p>no";</script></head><body><nav><ul><li><a href=/x>Home</a></li></ul></nav><div class="cookie-notice">We use cookies. <button>Accept</button></div>
<article><h1>Big   News</h1><p><b>First &amp; last<br><p>Second <a href="y">word</a> here, and more of it follows.</article><section class=comments><div class=comment><p>I disagree with all of this.</p></div></section><footer>&copy; me</footer></body>"""


def test_blocks():
    assert [b.text for b in blocks_of(PAGE)] == ["Home", "We use cookies.", "Accept", "Big News", "First & last", "Second word here, and more of it follows.", "I disagree with all of this.", "© me"]
    assert blocks_of("") == [] and [b.text for b in blocks_of("bare < text")] == ["bare < text"] and blocks_of("<script>x") == []


def test_hidden_elements_without_end():
    texts = lambda page: [b.text for b in blocks_of(page)]
    assert texts('<p>one <svg width="9"/> two</p><p>three</p><svg><text>no</text></svg><p>four</p>') == ["one two", "three", "four"]
    assert texts("<p>one</p><noscript><p>two</p>") == ["one", "two"]
    assert texts("<p>one</p><script>var x = '<p>two</p>'") == ["one"]


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<a b=\">\" ", "<svg>", "<div>x", "<b>", "</x><div>", "<!-", "&amp", "<a '>\"", "</svg "])
def test_long_broken_pages_take_time_in_proportion(piece):
    def took(n):
        page = "<p>start</p>" + piece * n
        best = math.inf
        for _ in range(3):
            begun = time.process_time()
            blocks = blocks_of(page)
            best = min(best, time.process_time() - begun)
        assert blocks[0].text == "start" and all(len(b.path) <= 64 for b in blocks)
        return best

    took(100)
    assert took(80_000) < 0.5 + 30 * took(8_000)


def test_quotes_formulas_and_comments():
    texts = lambda page: [b.text for b in blocks_of(page)]
    assert texts('<p title="a > b">one</p><p title=\'x">two</p>') == ["one", "two"]
    assert texts("<p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p><!-- <p>no</p> --><p>3 < 4 <5</p>") == ["let x=2 be", "3 < 4 <5"]
    assert texts("<object><p>shown instead</p></object><select><option>a</select><p>end") == ["shown instead", "end"]


def test_gradients_are_those_of_the_loss():
    model = extraction.Labeller(1)
    pages = extraction.training_pages(3, 5)
    group, labels = [p for p, _ in pages], [y for _, y in pages]
    for name in ("xf", "hb", "out", "path"):
        _, g = model.gradients(group, labels)
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        step = 1e-2
        losses = []
        for d in (step, -2 * step):
            model.w[name][at] += d
            losses.append(model.gradients(group, labels)[0])
        model.w[name][at] += step
        assert (losses[0] - losses[1]) / (2 * step) == pytest.approx(g[name][at], rel=0.1, abs=1e-4)


def test_main_text(spark):
    rows = [(1, "u", PAGE, 5), (2, None, None, 6), (None, "w", "", 7), (1, "u", PAGE, 5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = extraction.main_text(df).collect()
    body = "Big News\nFirst & last\nSecond word here, and more of it follows."
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(1, "u", body, len(body)), (2, None, "", 0), (None, "w", "", 0), (1, "u", body, len(body))]))
    assert extraction.main_text(df.limit(0)).count() == 0


def test_labeller_on_new_layouts():
    model = extraction.train([], made=500)
    rng = random.Random(77)
    right = wrong = missed = 0
    for _ in range(150):
        page, main = extraction.made_page(rng)
        got = set(extraction.extract(model, [page])[0].split("\n")) - {""}
        right, wrong, missed = right + len(got & main), wrong + len(got - main), missed + len(main - got)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_queries_that_search_together_find_what_they_find_alone():
    rng = np.random.default_rng(4)
    for scale in (3, 256, 40_000, 2**27, 2**29):  # many ties; products that fit narrow floats, wide floats and integers only
        rows = rng.integers(-scale, scale + 1, (700, 5))
        tree, other = (metric.MTree.unpacked(metric.MTree(ids, rows[ids], capacity=16).packed()) for ids in np.array_split(rng.permutation(700), 2))
        best = metric.Best(np.arange(0, 700, 7), rows[::7], 5)
        for t in (tree, other):
            t.search_all(best, most=30)
        s = rows[::7] @ rows.T
        want = [(q, j, s[i, j]) for i, q in enumerate(range(0, 700, 7)) for j in [j for j in np.lexsort((np.arange(700), -s[i])) if j != q][:5]]
        assert list(zip(*best.found())) == want


def test_what_top_k_sends_grows_with_the_table():
    for rows in (10_000, 100_000, 1_000_000, 15_000_000, 80_000_000):
        queries, trees = rows // 50, -(-rows // 8192)
        across, down = metric.grid(rows, queries, trees)
        assert across * down <= 400 and rows / across <= 1_000_000 and queries / down <= 1_000_000
        assert across * queries + down * rows <= 9 * rows
