"""Models against plain loops, and rows that are odd: very long, empty, repeated, null or with clashing names."""

import math
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from inkloom.llm import encoding, extraction, langid, lm, packing, quality
from inkloom.llm.markup import blocks_of
from tests.llm.test_llm_text import BYTE, WORD, brute_bits, brute_dedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, held_out int, n_lines string, _text int, lang_pred string, accepted int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, l, "s", None if t is None else len(t), 0.5, 1, "x", 2, "y", 3) for i, t, l in rows], DOCS)


def test_scores_are_those_of_a_loop_over_ids():
    rng = np.random.default_rng(4)
    classes = np.array([0, 0, 1, 2, 2, 2, 3, 3, 1])
    end, shape = 8, lm.Shape(2, 3, 4)
    model = lm.CausalModel(classes, 4, shape)
    documents = [np.append(rng.integers(0, 8, n), end).astype("i4") for n in (0, 1, 2, 7, 30)]
    model.fit(documents, end, epochs=2, batch=4)
    model.prepare()
    first = np.zeros(9, bool)
    first[[2, 6, 8]] = True
    within = lm.Within(classes, rng.integers(1, 9, 9).astype("f8"), first, np.array([0, 1, 2, 3, 4, 5, 5, 5, 5]), rng.integers(0, 4, (5, 5)).astype("f8"))
    w, got = {k: v.astype("f8") for k, v in model.w.items()}, lm.Scorer(model, within, end).scores(documents, most=2)
    for ids, score in zip(documents, got):
        padded, total = [end] * (shape.context + 1) + ids.tolist(), 0.0
        for i, target in enumerate(ids.tolist()):
            start = i // shape.scored * shape.scored
            cell = i - start
            read = padded[start : start + shape.context + cell + 1]  # the ids before, from the window's first cell on
            x = [w["id"][a] + w["place"][j] for j, a in enumerate(read)]
            q = x[-1] @ w["query"] / math.sqrt(shape.size)
            weight = [math.exp(q @ (y @ w["key"])) for y in x]
            mixed = sum(a * (y @ w["value"]) for a, y in zip(weight, x)) / sum(weight)
            z = mixed @ w["out"] + w["latest"][read[-1]] + w["bias"]
            total += z[classes[target]] - math.log(np.exp(z).sum())
            total += float(within.logs(np.array([read[-1]]), np.array([target]))[0])
        assert score == pytest.approx(total / math.log(10), rel=1e-4)


def test_the_model_beats_word_counts_on_held_out_texts(spark):
    rng = random.Random(8)
    after = {f"word{i}": [f"word{(3 * i + k) % 60}" for k in (1, 2, 5)] for i in range(60)}
    rows = []
    for i in range(400):
        text = [f"word{rng.randint(0, 59)}"]
        while len(text) < 30:
            text.append(rng.choice(after[text[-1]]))
        rows.append((i, " ".join(text), "en"))
    held = [r for r in lm.score_texts(docs_of(spark, rows), BYTE).collect() if r["held_out"]]
    assert len(held) > 30 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_the_labeller_is_a_loop_over_blocks():
    model = extraction.Labeller(2)
    pages = [p for p, _ in extraction.training_pages(6, 9)]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    size = extraction.HIDDEN_SIZE
    for page, got in zip(pages, model.scores(pages)):
        mean = lambda table, rows: table[rows].mean(0) if rows else np.zeros(table.shape[1])
        x = [np.concatenate([mean(model.w["path"], a), mean(model.w["word"], b), c]) for a, b, c in zip(page.paths, page.words, page.numbers)]
        states = []
        for way, order in (("f", x), ("b", x[::-1])):
            h, c, out = np.zeros(size), np.zeros(size), []
            for y in order:
                z = y @ model.w["x" + way] + h @ model.w["h" + way] + model.w["b" + way]
                i, f, o = (sigmoid(z[k * size : (k + 1) * size]) for k in range(3))
                c = f * c + i * np.tanh(z[3 * size :])
                h = o * np.tanh(c)
                out.append(h)
            states.append(out if way == "f" else out[::-1])
        want = [np.concatenate([a, b, y]) @ model.w["out"] + model.w["bias"][0] for a, b, y in zip(*states, x)]
        assert np.allclose(got, want, atol=1e-3)


def test_logistic_regression_is_at_its_minimum():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 6)).astype("f4")
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=400) > 0.2).astype("f8")
    w = quality.fit(x, y, np.ones(400), ridge=1e-2, steps=600).astype("f8")
    z = np.concatenate([x, np.ones((400, 1))], 1)
    slope = z.T @ (1 / (1 + np.exp(-z @ w)) - y) / 400 + 1e-2 * w * np.r_[np.ones(6), 0]
    assert np.abs(slope).max() < 1e-3


def test_views_teach_each_other():
    rng = np.random.default_rng(6)
    n = 600
    y = rng.integers(0, 2, n)
    views = [np.stack([y + rng.normal(size=n) * 0.3, rng.normal(size=n)], 1).astype("f4") for _ in range(2)]
    label = np.where(np.arange(n) < 60, y, -1)
    model = quality.co_train(*views, label)
    joined = model.score(*views)[2] >= 0.5
    assert (joined == (y > 0)).mean() > 0.97


LONG = ("The house, a garden and 12 trees stood by the water. " * 40 + "\n") * 900  # 1.9 MB


def test_very_long_texts_are_read_whole(spark):
    rows = [(i, t, "en") for i, t in enumerate([LONG, None, "", "short text of a few words", "short text of a few words"])]
    docs = docs_of(spark, rows)
    byte, word = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    got = {r["doc_id"]: r for r in encoding.round_trip_digest(docs, BYTE).collect()}
    assert got[0]["n_tokens"] == len(byte.encode(LONG, add_special_tokens=False).ids) and got[1]["n_tokens"] == 0
    pieces = packing.pack(docs, WORD).where("doc_id = 0").collect()
    assert sum(r["length"] for r in pieces) == len(word.encode(LONG, add_special_tokens=False).ids) + 1
    named = {r["doc_id"]: r for r in langid.predict_languages(docs).collect()}
    assert named[0]["lang_pred"] == "en" and named[1]["lang_pred"] == named[2]["lang_pred"] == "und"
    scored = {r["doc_id"]: r for r in lm.score_texts(docs, BYTE, common_words=5).collect()}
    assert scored[0]["n_tokens"] == len(LONG.split()) + 1 and scored[3]["score"] == scored[4]["score"]
    labels = spark.createDataFrame([(3, 1, 0), (1, 0, 0)], "doc_id bigint, quality int, toxic int")
    judged = quality.score_quality(docs, labels)
    assert judged.count() == 5 and judged.columns.count("score") == judged.columns.count("accepted") == 1
    page = "<article><h1>Top</h1>" + "<p>One more sentence that stands here.</p>" * 20_000 + "</article>"
    texts = extraction.main_text(spark.createDataFrame([(1, "u", page, 1)], "page_id bigint, url string, html string, text int")).first()
    assert texts["n_chars"] == len("Top") + 20_000 * len("\nOne more sentence that stands here.")
    assert len(blocks_of(page)) == 20_001


def test_hot_ids_do_not_fill_the_driver(spark):
    same = [(7, "the same text of one id", "en")] * 3000 + [(None, f"text {i} without id", "en") for i in range(300)]
    docs = docs_of(spark, same + [(i, f"house number {i} stands here", "fr") for i in range(100, 200)])
    sample = langid.sample_texts(langid.lettered(docs), per_language=50)
    assert len(sample["en"]) <= 50 + 40 and len(set(sample["en"])) == len(sample["en"])
    labels = spark.createDataFrame([(7, 1, 0), (100, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.score_quality(docs, labels).count() == docs.count()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("odd")
    rng = random.Random(3)
    words = {"en": "the house and water with a tree".split(), "fr": "le maison et les eaux avec un arbre".split()}
    text = lambda l, n: "\n".join(" ".join(rng.choice(words[l]) + str(rng.randint(0, 30)) for _ in range(9)) for _ in range(n))
    passage = text("en", 6)
    rows = [(i, text(l, 4) + ("\n" + passage if i % 10 == 0 else ""), l) for i in range(120) for l in [("en", "fr")[i % 2]]]
    rows += [(5, "again one id, another text", "en"), (5, "again one id, another text", "en"), (None, text("en", 3), None), (300, None, "en"), (301, "", "en"), (302, LONG[:200_000], "en")]
    docs_of(spark, rows).write.parquet(str(base / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(100)] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(base / "labels.parquet"))
    return str(base), rows


def test_line_stage_is_the_scan_over_places(spark, odd):
    folder, rows = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.line_dedup(spark, docs, folder).collect()
    want = [(i, t) for (i, t, n), _ in zip(brute_dedup([(i, t) for i, t, _ in rows]), rows) if not n or t.strip(" \n")]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, want))
    assert any(n for _, _, n in brute_dedup([(i, t) for i, t, _ in rows]))


def test_language_stage_is_the_walk_over_trees(spark, odd):
    folder, rows = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = langid.sample_texts(langid.lettered(docs))
    trees = {}
    for lang, ts in texts.items():
        stream, trees[lang] = b"\n" + b"\n".join(map(langid.normal, ts)) + b"\n", {}
        for k in range(4):
            for i in range(k, len(stream)):
                seen = trees[lang].setdefault(stream[i - k : i], {})
                seen[stream[i]] = seen.get(stream[i], 0) + 1
    got = {(r["doc_id"], r["text"]): r for r in langid.identify(docs, langid.train(texts), ("doc_id", "text")).collect()}
    for i, t, _ in rows[:20]:
        cost = brute_bits(trees, sorted(texts), 3, langid.normal(t))
        assert got[i, t]["lang_pred"] == sorted(texts)[int(np.argmin(cost))]
        assert got[i, t]["score"] == pytest.approx(1 / sum(2 ** (min(cost) - c) for c in cost)) and got[i, t]["bits_per_byte"] == pytest.approx(min(cost) / len(t.lower().encode()))
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, folder).collect()}
    assert set(range(120)) <= kept and not kept & {300, 301}
    strange = docs_of(spark, [(1000, "ЖЩЪЫЭЮЯ " * 30, None), *rows])
    assert 1000 not in {r["doc_id"] for r in corpus_pipeline.language_id(spark, strange, folder).collect()}


def test_pipeline_takes_odd_rows_and_empty_tables(spark, odd, tmp_path):
    folder, rows = odd
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in out} >= set(range(101, 120)) and all(zlib.crc32(b"") != r["ids_crc32"] for r in out)
    docs_of(spark, rows).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
