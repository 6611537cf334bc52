import inspect
import math
import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkloom.llm import encoding, jaccard, langid, linededup, lm, packing, quality
from inkloom.llm.bpe import ByteBpe, WordBpe
from inkloom.llm.library import SpacedWords, WordIds, words_in

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_lines int, _mark int, node int"
ODD = ["", "  ", "a  b   c \n\n d", "x <|endoftext|> y", " lead", "it's we'll 'S", "日本語 😀 é é ΑΣ İ", "\x1c a\x1fb \x85   z", "12345 ٣", "\n", "don't\t\tstop.\r\n"]


def words_of(text):
    return text.encode().lower().split()


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "c", 1, 2, 3) for i, t in rows], DOCS)


def texts(seed, n, vocabulary=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 9))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 8, 40, 200]))) for _ in range(n)]


@pytest.mark.parametrize(("kind", "path"), [(ByteBpe, BYTE), (WordBpe, WORD)])
def test_encodes_as_the_library(kind, path):
    rng = random.Random(3)
    own, library = kind(path), Tokenizer.from_file(path)
    noise = ["".join(rng.choice("ab cdeéß\n\t '.,!#12THE<|>日😀́") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for t in ODD + noise + texts(1, 50):
        ids = np.frombuffer(own.encode(t), "<u4").tolist()
        assert ids == library.encode(t, add_special_tokens=False).ids, t
        if kind is ByteBpe:
            assert own.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_distinct_words_are_encoded_as_the_library_encodes_texts():
    rng = random.Random(5)
    own, library = WordIds(WORD), Tokenizer.from_file(WORD)
    noise = ["".join(rng.choice("ab cdeéß\n\t '.,!#12THEΣİ<|>日😀́\r\u2028") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    given = ODD + ["a<|endoftext|>B <|startoftext|>", None, "Σ ΑΣ ΣΑ"] + noise + texts(1, 50)
    ids, ends = own.ids(pa.array(given, pa.string()))
    at = 0
    for t, end in zip(given, ends.tolist()):
        assert ids[at:end].tolist() == library.encode(t or "", add_special_tokens=False).ids, t
        at = end
    assert at == len(ids)


def test_spaced_words_are_encoded_as_by_the_automaton():
    rng = random.Random(6)
    own, bpe = SpacedWords(BYTE), ByteBpe(BYTE)
    noise = ["".join(rng.choice("ab cdeéß\n\t '.,!#12THEΣİ<|>日😀́\r\u2003\x85\x1c\x0b") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    given = ODD + ["a<|endoftext|>B", None, "\u2003", "x\u2003 y"] + noise
    found, at, count = words_in(pa.array(given, pa.string()))
    stream, sizes = own.stream(found.to_pylist(), at, count)
    ends = np.cumsum(sizes)
    assert (own.size, own.end) == (len(bpe.labels), len(bpe.labels) - 1)
    assert own.begins.tolist() == [x[:1] == b" " or i == own.end for i, x in enumerate(bpe.labels)]
    for t, a, b, n in zip(given, ends - sizes, ends, count):
        words = words_of(t or "")
        assert n == len(words)
        assert stream[a:b].tolist() == [i for w in words for i in np.frombuffer(bpe._plain(" " + w.decode()), "<u4").tolist()] + [own.end], t


def test_digests_and_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (3, None), (1, "same"), (1, "same")]
    docs = docs_of(spark, rows)
    got = encoding.round_trip_digest(docs, BYTE).collect()
    library = Tokenizer.from_file(BYTE)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    back = encoding.bpe_decode(encoding.bpe_encode(docs, BYTE), BYTE).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t in rows)
    assert encoding.round_trip_digest(docs.limit(0), BYTE).count() == 0


def test_first_fit_is_first_fit():
    rng = random.Random(4)
    for _ in range(50):
        sizes = np.array([rng.randint(1, 30) for _ in range(rng.randint(1, 60))])
        bins, offsets = packing.first_fit_decreasing(sizes, 30)
        rooms = []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            place = next((k for k, r in enumerate(rooms) if r >= sizes[i]), None)
            if place is None:
                place = len(rooms)
                rooms.append(30)
            assert (bins[i], offsets[i]) == (place, 30 - rooms[place])
            rooms[place] -= sizes[i]


def test_packing_holds_every_id_once(spark):
    rows = [(i, t) for i, t in enumerate(texts(5, 60))] + [(100, None), (101, ""), (None, "null id"), (7, "again"), (102, "word " * 5000)]
    got = packing.pack(docs_of(spark, rows), WORD, length=256, group_pieces=20).collect()
    library = Tokenizer.from_file(WORD)
    whole = [np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for _, t in rows]
    assert sum(r["length"] for r in got) == sum(map(len, whole))
    crcs = sorted(zlib.crc32(x[a : a + 256].tobytes()) for x in whole for a in range(0, len(x), 256))
    assert sorted(r["ids_crc32"] for r in got) == crcs
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(docs_of(spark, []), WORD).count() == 0


def brute_bits(trees, languages, order, text):
    """Code lengths by walking the trees byte by byte."""
    out = []
    for lang in languages:
        total = 0.0
        for i, byte in enumerate(text):
            p, k = 1.0, min(order, i)
            while k >= 0:
                seen = trees[lang].get(text[i - k : i])
                if seen:
                    n, d = sum(seen.values()), len(seen)
                    if byte in seen:
                        p *= seen[byte] / (n + d)
                        break
                    p *= d / (n + d)
                k -= 1
            else:
                p /= 256
            total -= math.log2(p)
        out.append(total)
    return out


def test_language_code_lengths_are_exact():
    sample = {"aa": ["the cat sat on the mat " * 3], "bb": ["le chat était là " * 3]}
    model = langid.train(sample, order=3)
    trees = {}
    for lang, ts in sample.items():
        stream = b"\n" + b"\n".join(map(langid.normal, ts)) + b"\n"
        trees[lang] = {}
        for k in range(4):
            for i in range(k, len(stream)):
                seen = trees[lang].setdefault(stream[i - k : i], {})
                seen[stream[i]] = seen.get(stream[i], 0) + 1
    for text in (b"the chat sat", "là été zz".encode(), b"q" * 40):
        want = brute_bits(trees, model.languages, 3, text)
        for block in (5, 512):
            assert np.allclose(langid.code_lengths(model, [b"", b"xa", text, b""], block)[2], want, rtol=1e-12)


def test_no_context_is_dropped():
    rng = random.Random(12)
    sample = {lang: ["".join(rng.choice(letters) for _ in range(60_000))] for lang, letters in (("aa", "abcdefghijklmnopqrstuvwxyz"), ("bb", "0123456789klmnopqrstuvwxyzäöü"))}
    model = langid.train(sample)
    contexts = {t[i : i + 3] for t in ("\n" + sample["aa"][0], ) for i in range(len(t) - 3)}
    assert len(model.escape[3]) > 24_000 and len(contexts) > 15_000
    text = sample["bb"][0][:50].encode()
    assert langid.code_lengths(model, [text])[0].argmin() == 1
    assert [bool(langid.LETTER.search(t)) for t in ("½ ²", "12", "é", "中")] == [False, False, True, True]


def test_languages(spark):
    rng = random.Random(6)
    word = {"en": ["the", "and", "with", "house", "water"], "fr": ["le", "les", "avec", "maison", "été"]}
    rows = [(i, " ".join(rng.choice(word[l]) for _ in range(12)), l) for i in range(160) for l in [("en", "fr")[i % 2]]]
    rows += [(500, None, "en"), (501, "12 34 !", "fr"), (None, "the house with water", None), (502, "", "en"), (7, "les maison", "fr")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.predict_languages(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 7}
    assert all(by[i]["lang_pred"] == ("en", "fr")[i % 2] for i in range(160) if i != 7)
    assert [by[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and by[None]["lang_pred"] == "en" and by[None]["held_out"] is False
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert langid.predict_languages(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.predict_languages(df.where("lang IS NULL")).collect()} == {"und"}


def brute_dedup(rows):
    """What each (id, text) keeps, going through places in their order."""
    from hashlib import md5

    order = lambda r: (r[0] is not None, r[0] or 0, md5(r[1].encode()).hexdigest())
    met, kept = set(), {}
    for i, t in sorted(dict.fromkeys(r for r in rows if r[1] is not None), key=order):
        lines, gone = t.split("\n"), set()
        full = [k for k, x in enumerate(lines) if x.strip(" \t\r")]
        for a, b in zip(full, full[1:]):
            body = "\n".join(lines[a : b + 1])
            if body in met:
                gone |= set(range(a, b + 1))
            met.add(body)
        kept[i, t] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return [(i, None, 0) if t is None else (i, *kept[i, t]) for i, t in rows]


def test_lines(spark):
    rng = random.Random(8)
    blocks = [[f"line {rng.randint(0, 9999)}" for _ in range(rng.randint(2, 9))] for _ in range(12)]
    rows = [(i, "\n".join(x for _ in range(rng.randint(1, 4)) for x in (rng.choice(blocks) if rng.random() < 0.7 else [f"own {i} {rng.random()}"]))) for i in range(120)]
    rows += [(130 + i, "\n".join(x for b in rng.sample(blocks, 3) for x in [*b[rng.randint(0, 2) :], "", f"own {rng.random()}"])) for i in range(40)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "\n".join(f"long {i % 700}" for i in range(3000))), (None, "\n".join(blocks[0] * 2)), (3, rows[3][1]), (4, "other"), (205, "one line")]
    docs = docs_of(spark, rows)
    got = linededup.dedup_lines(docs).collect()
    assert sorted(map(str, ((r["doc_id"], r["text"], r["n_removed"]) for r in got))) == sorted(map(str, brute_dedup(rows)))
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
    assert linededup.dedup_lines(docs).columns.count("n_lines") == 1
    assert "Python" not in linededup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()


def test_windows_take_whole_passages(spark):
    passage = [f"passage line {i}" for i in range(5)]
    rows = [(1, "\n".join(["a1", *passage, "b1"])), (2, "\n".join(["a2", "a3", *passage[:3], "", *passage[3:], "b2"])), (3, "\n".join(["a4", *passage[1:3], "b3", passage[4]])), (4, "\n".join(passage)), (5, None), (6, ""), (7, "one"), (8, "\n\n")]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got[1] == (rows[0][1], 0) and got[3] == ("a4\nb3\npassage line 4", 2) and got[4] == ("", 5)
    assert got[2] == ("a2\na3\n\nb2", 5)
    assert [got[i] for i in (5, 6, 7, 8)] == [(None, 0), ("", 0), ("one", 0), ("\n\n", 0)]


def brute_components(rows):
    sets = {i: jaccard.shingle_set(t or "") for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = list(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_agrees_with_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows, n = [], 0
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 6, 8, 10, 15, 20, 30, 60, 150, 600]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(base) // 30)])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "A b c d e"), (n + 4, "a B c d e"), (n + 5, "a b\x0bc"), (None, "p q r s t u")]
    got = jaccard.similar_components(docs_of(spark, rows)).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_shingles"] == 2
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert jaccard.similar_components(docs_of(spark, [])).count() == 0
    assert [tuple(r) for r in jaccard.similar_components(docs_of(spark, [(1, None)])).collect()] == [(1, 0, 1)]


@pytest.mark.parametrize("percent", [50, 60, 70, 90])
def test_partners_share_a_signature_at_other_percentages(percent):
    rng = np.random.default_rng(percent)
    bands = [jaccard.choose(lo, hi, 1000, percent) for lo, hi in jaccard.band_edges(400, percent)]
    lows = np.array([b.low for b in bands], "i8")
    for size in [*range(1, 30), 40, 80, 200]:
        for _ in range(12):
            a = rng.integers(0, 1 << 62, size, dtype="u8")
            keep = size
            while keep > 1 and 100 * (keep - 1) >= percent * size:
                keep -= 1
            for b in (a[:keep], np.concatenate([a[:keep], rng.integers(0, 1 << 62, max(0, keep * 100 // percent - size), dtype="u8")])):
                both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
                if 100 * both < percent * union:
                    continue
                signed = [set(np.concatenate([jaccard.signatures(np.unique(x), k, bands[k], percent) for k in jaccard.bands_for(len(x), bands, lows, percent)]).tolist()) for x in (a, b)]
                assert signed[0] & signed[1], (size, len(b))


def test_every_id_is_scored_once():
    shape = lm.Shape(3, 5, 4)
    rng = np.random.default_rng(1)
    documents = [rng.integers(0, 50, n).astype("i4") for n in (1, 5, 6, 17)]
    inputs, target, live = lm.windows(documents, shape, 99)
    doc = lm.owners(documents, shape)
    for k, d in enumerate(documents):
        assert target[doc == k][live[doc == k]].tolist() == d.tolist()
        padded = [99] * shape.context + d.tolist()
        for row, (x, y) in enumerate(zip(inputs[doc == k], live[doc == k])):
            for j in np.flatnonzero(y):
                i = row * shape.scored + j
                assert x[shape.context + j] == (padded[i + shape.context - 1] if i else 99)


def test_attention_is_causal_and_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    classes = np.array([0, 0, 1, 2, 2, 2, 3, 3])
    model = lm.CausalModel(classes, 4, lm.Shape(2, 3, 4))
    documents = [rng.integers(0, 8, 40).astype("i4") for _ in range(20)]
    losses = model.fit(documents, 7, epochs=3, batch=8)
    assert losses[-1] < math.log(4)
    model.prepare()
    inputs, target, _ = lm.windows(documents, model.shape, 7)
    total = sum(np.exp(model.class_logs(inputs, np.full(target.shape, c))) for c in range(4))
    assert np.allclose(total, 1, atol=1e-4)
    changed = inputs.copy()
    changed[:, -1] = 3
    same = model.class_logs(inputs, classes[target]) - model.class_logs(changed, classes[target])
    assert np.abs(same[:, :-1]).max() < 1e-5
    first = np.zeros(8, bool)
    first[[2, 6]] = True
    group = lm.split(classes, first)
    within = lm.Within(group, rng.integers(1, 9, 8).astype("f8"), first, np.array([0, 1, 2, 3, 4, 5, 5, 5]), rng.integers(0, 4, (5, 5)).astype("f8"))
    for before in range(8):
        p = np.exp(within.logs(np.full(8, before), np.arange(8)))
        assert np.allclose(np.bincount(group, p), 1, atol=1e-5)


def test_the_shipped_model_looks_far_enough_back():
    rng = np.random.default_rng(3)
    model = lm.CausalModel(np.arange(12), 12, lm.Shape()).prepare()
    assert model.shape.size == 16 and model.shape.scored == 24
    inputs = rng.integers(0, 11, (1, model.shape.window))
    changed = inputs.copy()
    changed[0, model.shape.context - 8] = 11
    target = np.zeros((1, model.shape.scored), "i8")
    assert (model.class_logs(inputs, target) != model.class_logs(changed, target))[0, 0]
    defaults = inspect.signature(lm.train).parameters
    assert (defaults["classes"].default, defaults["pairs"].default) == (56, 2048)


def test_the_model_learns_pairs_of_words_from_all_texts(spark):
    rows = [(i, ("red house", "blue water")[i % 2]) for i in range(300)] + [(400, None)]
    docs = docs_of(spark, rows)
    bpe = ByteBpe(BYTE)
    ids = lambda t: [*np.frombuffer(b"".join(bpe._plain(" " + w.decode()) for w in words_of(t or "")), "<i4").tolist(), len(bpe.labels) - 1]
    want = {}
    for _, t in rows:
        for pair in zip([len(bpe.labels) - 1, *ids(t)], ids(t)):
            want[pair] = want.get(pair, 0) + 1
    table = lm.counted(docs, BYTE).where("pair IS NOT NULL").select("pair", "n")
    assert {divmod(r["pair"], len(bpe.labels)): r["n"] for r in table.collect()} == want
    assert [lm.texts_to_train(n, 400) for n in (0, 40_000, 250_000, 15_000_000)] == [400, 400, 1000, 7746]
    scorer = lm.train(docs, table, len(rows), BYTE, sample=1)
    score = dict(zip(texts := ["red house", "red water", "blue water", "blue house"], scorer.scores([np.array(ids(t), "i4") for t in texts])))
    assert score["red house"] > score["red water"] + 0.5 and score["blue water"] > score["blue house"] + 0.5


def test_all_texts_teach_attention_in_steps_of_their_task(spark):
    rows = [(i, t) for i, t in enumerate(texts(12, 120, 40))] + [(500, None), (501, "")]
    docs = docs_of(spark, rows).select("text").repartition(3).localCheckpoint()
    ids = lm.encoded(docs.withColumn("part", F.spark_partition_id()), BYTE).localCheckpoint()
    words, got = SpacedWords(BYTE), ids.collect()
    streams = [np.frombuffer(r["ids"], "<u2").astype("i4") for r in got]
    kept = {r["part"]: [x for x, y in zip(streams, got) if y["part"] == r["part"]] for r in got}
    assert len(kept) == 3 and sum(x.tolist() == [words.end] for x in streams) == 2
    model = lm.CausalModel(np.arange(words.size) % 12, 12, lm.Shape(2, 3, 4))
    model.fit(streams[:2], words.end, epochs=1, batch=8)
    before = {k: v.copy() for k, v in model.w.items()}
    loss = lambda: -lm.Scorer(model.prepare(), lm.Within(model.classes, np.ones(words.size), words.begins, np.full(words.size, 2, "i4"), np.zeros((2, 2), "f4")), words.end).scores(streams).sum()
    at_first, total = loss(), {k: np.zeros(v.shape) for k, v in before.items()}
    met, every = np.bincount(np.concatenate(streams), minlength=words.size), sum(map(len, streams))
    for part in kept.values():
        mine, steps, rng = lm.CausalModel(model.classes, 12, model.shape), model.steps.copy(), np.random.default_rng(10)
        mine.w = {k: v.copy() for k, v in before.items()}
        inputs, target, live = lm.windows(part, model.shape, words.end)
        order = rng.permutation(len(inputs))
        for at in range(0, len(order), 16):
            k = order[at : at + 16]
            steps.take(mine.w, mine.step(inputs[k], model.classes[target[k]], live[k])[1], 0.005)
        here = np.bincount(np.concatenate(part), minlength=words.size)
        for k in total:
            total[k] += (mine.w[k] - before[k]) * (here[:, None] / np.maximum(1, met)[:, None] if k == "id" else sum(map(len, part)) / every)
    lm.taught(model, ids, words.end, batch=16)
    assert all(np.allclose(model.w[k], before[k] + total[k], atol=1e-4) for k in total)
    assert loss() < at_first


def test_steps_from_far_out_weights_stay_numbers():
    model = lm.CausalModel(np.arange(8) % 4, 4, lm.Shape(2, 3, 4))
    inputs, target, live = lm.windows([np.arange(8).astype("i4")], model.shape, 7)
    for name, by in (("query", 1e4), ("bias", -500), ("bias", 500)):
        held, model.w[name] = model.w[name], (model.w[name] + 1) * np.float32(by)
        loss, g = model.step(inputs, model.classes[target], live)
        assert all(np.isfinite(x[1] if isinstance(x, tuple) else x).all() for x in g.values()), name
        assert loss == loss
        model.w[name] = held


def test_the_loss_of_far_out_scores_is_exact():
    model = lm.CausalModel(np.arange(8) % 4, 4, lm.Shape(2, 3, 4))
    model.w["out"][:] = 0
    model.w["bias"] = np.array([0, 90, 200, 300], "f4")
    inputs, target, live = lm.windows([np.arange(8).astype("i4")], model.shape, 7)
    assert model.step(inputs, model.classes[target], live)[0] == pytest.approx((300 + 210 + 100 + 0) / 4, rel=1e-5)


def test_a_step_by_parts_is_that_of_the_whole_batch():
    rng = np.random.default_rng(15)
    model = lm.CausalModel(np.arange(40) % 9, 9, lm.Shape(2, 3, 4))
    model.w["bias"] = rng.normal(size=9).astype("f4")
    inputs, target, live = lm.windows([rng.integers(0, 40, n).astype("i4") for n in (7, 11, 1, 20)], model.shape, 39)
    target = model.classes[target]
    loss, whole = model.step(inputs, target, live, most=100)
    for most in (1, 3, 5):
        again, parts = model.step(inputs, target, live, most=most)
        assert again == pytest.approx(loss, rel=1e-5)
        for k, g in whole.items():
            assert np.allclose(*((x[1] if k == "id" else x) for x in (g, parts[k])), rtol=1e-4, atol=1e-6), k


def test_words_are_told_apart_by_their_ids():
    own = SpacedWords(BYTE)
    odd = ["don't", "don'", "'t", "a.", "a", ".", "<|endoftext|>", "x\u00a0y", "\u00a0", "\u2003z", "\x1c", "\x00", "é", "e\u0301", "日本語", "ΣΑΣ", "\U0001f600!", "1234567", "a" * 3000, "--", "ab", "abc"]
    given = [" ".join(odd), None, "", " a  a\tab ", " ".join(odd[::-1])]
    found, at, count = words_in(pa.array(given, pa.string()))
    stream, sizes = own.stream(found.to_pylist(), at, count)
    keys, place, starts = lm.spelled(stream, own)
    keys, text = keys.to_pylist(), np.repeat(np.arange(len(given)), sizes)[starts]
    assert len(set(keys)) == len(keys) == len(found) + 1 and np.bincount(text).tolist() == (count + 1).tolist()
    end = np.array([own.end], "<u2").tobytes()
    got = [[keys[x] for x in place[text == k]] for k in range(len(given))]
    assert all(g[-1] == end and end not in g[:-1] for g in got)
    same = dict(zip([k for g in got for k in g[:-1]], found.take(pa.array(at)).to_pylist()))
    assert [same[k] for g in got for k in g[:-1]] == found.take(pa.array(at)).to_pylist() and len(same) == len(found)


def test_texts_beyond_the_first_ones_teach_the_model(spark):
    rows = [(i, t) for i, t in enumerate(texts(13, 200, 30))]
    docs = docs_of(spark, rows)
    first = lm.drawn(docs, lm.texts_to_train(200, 1) / 200, seed=31)
    table = lm.counted(docs, BYTE).where("pair IS NOT NULL").select("pair", "n").localCheckpoint()
    a, b = (lm.train(d, table, 200, BYTE, sample=1).model.w for d in (docs, first))
    assert 0 < first.count() < 100 and np.abs(a["out"] - b["out"]).max() > 1e-3


def test_the_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(6)
    model = lm.CausalModel(np.array([0, 0, 1, 2, 2, 2, 3, 3]), 4, lm.Shape(2, 3, 4))
    inputs, target, live = lm.windows([rng.integers(0, 8, n).astype("i4") for n in (7, 11, 1)], model.shape, 7)
    target = model.classes[target]
    for k, g in model.step(inputs, target, live)[1].items():
        if k == "id":
            table = np.zeros_like(model.w["id"])
            np.add.at(table, g[0], g[1])
            g = table
        way = rng.normal(size=g.shape).astype("f4")
        held, found = model.w[k], []
        for by in (0.01, -0.01):
            model.w[k] = held + np.float32(by) * way
            found.append(model.step(inputs, target, live)[0])
        model.w[k] = held
        assert (found[0] - found[1]) / 0.02 == pytest.approx(float((g * way).sum()), rel=0.02, abs=1e-4), k


def test_language_model(spark):
    rows = [(i, t) for i, t in enumerate(texts(10, 80, 60))] + [(100, None), (101, ""), (None, "no id A"), (5, "again"), (102, "dup"), (102, "dup")]
    got = lm.score_texts(docs_of(spark, rows), BYTE, common_words=20).collect()
    assert len(got) == len(rows)
    counts, held = {}, lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in rows:
        if not held(i):
            for w in [*words_of(t or ""), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        w = [*words_of(t or ""), None]
        want.append((str(i), held(i), len(w), sum(x in counts for x in w), n, round(sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w), 6)))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(want)
    assert all(r["score"] < 0 for r in got)
    assert lm.score_texts(docs_of(spark, []), BYTE).count() == 0


def test_quality(spark):
    rng = random.Random(11)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(30)).capitalize() + "."
    bad = lambda: " ".join("".join(rng.choice("ABCDEF") for _ in range(5)) + "!!" for _ in range(30))
    rows = [(i, good() if i % 4 else bad()) for i in range(200)]
    docs = docs_of(spark, rows + [(900, None), (None, good()), (901, "")])
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 120)] + [(3, None, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    assert all(got[i]["accepted"] == (i % 4 > 0) for i in range(200))
    assert all(0 <= got[i]["score"] <= 1 for i in got) and len(got) == 203
    assert quality.score_quality(docs.limit(0), labels).count() == 0
    assert {r["accepted"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {True}
