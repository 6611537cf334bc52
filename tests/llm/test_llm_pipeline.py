"""The pipeline on a small folder of tables: what each stage keeps, held against brute force."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from inkloom.llm import jaccard
from inkloom.llm.queries import oracle_sql, queries

WORDS = ["the", "and", "with", "house", "water", "tree", "light", "garden", "river", "stone", "cloud", "paper"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    rng = random.Random(1)
    text = lambda: "\n".join(" ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(12)).capitalize() + "." for _ in range(5))
    rows = [(i, text(), "en", f"s{i % 3}") for i in range(80)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in rows[i][1].split()), "en", "s1") for i in range(20)]
    rows += [(300, rows[3][1] + " tail", "en", "s0"), (301, rows[4][1], "en", "s0"), (302, "1 2 3 4", "en", "s1"), (303, None, "en", "s1"), (304, "", None, None)]
    docs = spark.createDataFrame([(i, t, l, s, len(t or "")) for i, t, l, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(base / "documents.parquet"))
    labels = [(i, int(i < 200), 0) for i, *_ in rows if i < 60 or 200 <= i < 216]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(base / "labels.parquet"))
    return str(base)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append({r["doc_id"] for r in docs.collect()})
    assert set(range(80)) <= kept[0] and not kept[0] & set(range(200, 220))
    assert set(range(80)) <= kept[1] and not kept[1] & {302, 303, 304}
    assert set(range(80)) <= kept[2]
    sets = {r["doc_id"]: jaccard.shingle_set(r["text"]) for r in docs.collect()}
    assert set(range(80)) <= kept[3]
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                assert 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect()}
    assert {r["doc_id"]: r["doc_tokens"] for r in out} == want


def test_near_duplicates_go_by_id_and_text(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(1, text(1), "en"), (5, text(1) + " tail", "en"), (5, text(2), "en"), (5, text(2), "fr"), (7, text(3), "en"), (7, text(3) + " tail", "en"), (None, text(4), "en"), (None, text(4), "en")]
    docs = spark.createDataFrame([(i, t, l, "s", len(t)) for i, t, l in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = [(r["doc_id"], r["text"].split()[0], r["lang"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "w1x0", "en"), (5, "w2x0", "en"), (7, "w3x0", "en"), (None, "w4x0", "en")]))


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() >= 80


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
    assert set(oracle_sql()) <= set(queries())
