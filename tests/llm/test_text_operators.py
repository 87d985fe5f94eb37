import collections
import hashlib
import json
import math
import re
import timeit
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import bpe, decontamination, kernels, language, licenses, minhash, quality, queries, secrets

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "A b", "###", "日本語 の テキスト", "x" * 70_000, "word " * 20_000, "é́ ½ Ⅷ 𝒳"]


def docs_of(spark, texts, **more):
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit(v) for c, v in more.items()})


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, k=5):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


# --- kernels


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abAB \n\té日", max_size=60), max_size=8))
def test_shingle_sets_match_python(texts):
    batch = pa.RecordBatch.from_arrays([pa.array([*texts, None], pa.string())], names=["text"])
    got = []
    for _, _, data, offsets in kernels.text_chunks(batch, limit=40):
        values, at = kernels.distinct_sets(*kernels.shingle_hashes(*kernels.word_hashes(data, offsets)))
        got += [set(values[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    expected = [shingles(t) for t in [*texts, None]]
    assert [len(s) for s in got] == [len(s) for s in expected]
    for i in range(len(got)):
        for j in range(i):
            assert len(got[i] & got[j]) == len(expected[i] & expected[j])


ODD_BYTES = ["", "a", "a b", "  a  b  c d e f ", "xé日 " * 50, "w" * 500, "A b\n" + "long" * 90 + " c. d e f g\n\nA b\n" * 5, " " * 300, "one two three four five six " * 40]


@pytest.mark.parametrize("size", [5, 64, 1000])
def test_long_texts_are_read_in_pieces(size):
    """Shingles, keys, sketches and statistics of a text in pieces are those of the whole."""
    for text in ODD_BYTES:
        data = np.frombuffer(text.encode(), np.uint8)
        whole = np.array([0, len(data)])
        for space in (None, decontamination.separators()):
            words = [w for i, j, h in kernels.word_stream(data, space, size) for w in h.tolist()]
            assert words == kernels.word_hashes(data, whole, space)[0].tolist()
            for k in (3, 5):
                assert kernels.long_shingles(data, k, space, size).tolist() == kernels.distinct_sets(*kernels.shingle_hashes(*kernels.word_hashes(data, whole, space), k))[0].tolist()
        assert quality.long_statistics(data, size) == pytest.approx(quality.statistics(data, whole)[0])
    batch = pa.RecordBatch.from_arrays([pa.array([*ODD_BYTES, None], pa.string())], names=["text"])
    get = lambda limit: [values[a:b].tolist() for _, _, values, at in kernels.shingle_sets(batch, 5, limit=limit) for a, b in zip(at[:-1], at[1:])]
    assert get(size) == get(1 << 20)


def test_sketches_and_keys_of_a_large_set_are_taken_in_slices(monkeypatch):
    values = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64))
    one, two = np.array([0, len(values)]), np.array([0, len(values), len(values) + 1])
    more = np.append(values, np.uint64(7))
    for module in (kernels, minhash):
        monkeypatch.setattr(module, "CHUNK", 777)
    assert (kernels.sketches(values, one, 8)[0] == kernels.sketches(more, two, 8)[0]).all()
    assert [k[0] for k in minhash.set_keys(values, one)] == [k[0] for k in minhash.set_keys(more, two)]


# --- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab  \n\t'sStTrRe.,!é日½_<|>　\x85", max_size=60), st.lists(st.sampled_from(["<|endoftext|>", " the", "  ", "\n", "ing", "'ll", "!!"]), max_size=8).map("".join)))
def test_bpe_equals_the_library(text):
    from tokenizers import Tokenizer

    lib = test_bpe_equals_the_library.__dict__.setdefault("lib", Tokenizer.from_file(VOCABULARY))
    ids = np.frombuffer(bpe.encoder(VOCABULARY).encode(text), "<u4").astype(np.int64)
    assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
    assert bpe.encoder(VOCABULARY).decode(ids).decode() == lib.decode(ids.tolist(), skip_special_tokens=False) == text


def test_bpe_decodes_broken_utf8(library):
    ids = library.encode("日本", add_special_tokens=False).ids[:1]
    assert bpe.encoder(VOCABULARY).decode(np.array(ids)).decode() == library.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark, library):
    df = docs_of(spark, ODD, ids="clash")
    rows = {r["doc_id"]: r for r in bpe.round_trip_digests(df.union(df), VOCABULARY).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for k, t in enumerate(ODD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert tuple(rows[k])[1:] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode()))
    encoded = bpe.encode(df, VOCABULARY)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded, VOCABULARY).collect()} == {k: t or "" for k, t in enumerate(ODD)}
    assert bpe.round_trip_digests(df.limit(0), VOCABULARY).count() == 0


# --- secrets


def plain_base(text):
    text = text or ""
    a = [(m.start(), m.end(), "assign") for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    b = [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    c = [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(a + b + c, key=lambda s: (s[0], secrets.KINDS[s[2]]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "=", " : ", "ſecret", "API_KEY", "apiKey", "'", '"', "abcdef", "x1", "AKIA", "A" * 16, "deadbeef", "0" * 9, "\n", " ", "passwd", "é"]), max_size=14).map("".join))
def test_base_spans(text):
    assert secrets.base_spans(text) == plain_base(text)


def entropy(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in collections.Counter(s).values())


@settings(max_examples=100, deadline=None)
@given(st.text("abcdef0189", min_size=0, max_size=70), st.floats(1.0, 3.4))
def test_windows_match_brute_force(text, least):
    size = 12
    covered = set()
    for k in range(len(text) - size + 1):
        if entropy(text[k : k + size]) >= least + 1e-9:
            covered |= set(range(k, k + size))
    near = any(abs(entropy(text[k : k + size]) - least) < 1e-9 for k in range(len(text) - size + 1))
    got = {k for a, b in secrets.windows(text, size, least) for k in range(a, b)}
    assert near or got == covered


def test_secrets_rows(spark):
    random_key = "q7Rk2LmZ9xTb4VnC8sWd"
    texts = [f"key {random_key}G5h here", "password: hunter2x", "0123456789 example_token_ABC123def456ghi", None, "", "x" * 100_000, "550e8400-e29b-41d4-a716-446655440000", f"token={random_key}"]
    df = docs_of(spark, texts, spans="clash")
    rows = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    assert rows[0]["spans"].startswith("entropy_base64:4:") and rows[1]["spans"] == "assign:0:18"
    assert [rows[k]["spans"] for k in (3, 4, 5, 6)] == [""] * 4 and rows[7]["spans"].startswith("assign:0:")
    for k, t in enumerate(texts):
        assert rows[k]["base_sha256"] == hashlib.sha256(secrets.joined(plain_base(t)).encode()).hexdigest()
    masked = {r["doc_id"]: r for r in secrets.redact(df).collect()}
    assert random_key not in masked[0]["text"] and masked[1]["text"] == "[SECRET]" and masked[3]["text"] is None and masked[1]["n_chars"] == 8
    assert masked[0].asDict().keys() == df.first().asDict().keys() and secrets.scan(df.limit(0)).count() == 0


# --- decontamination


def test_leaks_match_brute_force(spark):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{k}" for k in range(300)]
    say = lambda n: " ".join(rng.choice(vocabulary, n))
    items = [say(int(n)) for n in (3, 5, 8, 20, 40, 40, 120)] + [None, "", "..."]
    items.append(items[4])
    texts = [*ODD]
    for k in range(60):
        item = (items[int(rng.integers(0, 7))]).split()
        for _ in range(int(rng.integers(0, 3))):
            item[int(rng.integers(0, len(item)))] = "changed"
        texts.append(say(int(rng.integers(0, 400))) + " " + " ".join(item).upper() + ". " + say(30))
    texts.append(items[0])
    df = docs_of(spark, texts, leaks="clash")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    clean = lambda t: shingles(re.sub(r"[^0-9a-zA-Z\u0080-\U0010ffff]", " ", t or ""))
    expected = {(i, j) for i, t in enumerate(texts) for j, b in enumerate(items) if (q := clean(b)) and 100 * len(q & clean(t)) >= 80 * len(q)}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leak_pairs(df, bench).collect()}
    assert got == expected and len(got) > 20
    leaks = {(r["doc_id"], x["item_id"]) for r in decontamination.find_leaks(df, bench).collect() for x in r["leaks"]}
    assert leaks == expected
    twice = df.union(df.where("doc_id >= 11")).withColumns({"salt": F.lit("clash"), "t1": F.lit("clash")})
    assert decontamination.leak_pairs(twice, bench).count() == 2 * len(expected)
    kept = decontamination.drop_contaminated(df.drop("leaks"), bench)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in expected} and kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert decontamination.leak_pairs(df.limit(0), bench).count() == 0 == decontamination.leak_pairs(df, bench.limit(0)).count()


# --- language


def test_viterbi_word_by_word_agrees_with_blocks():
    for seed in range(300):
        rng = np.random.default_rng(seed)
        begin = np.concatenate([[0], np.cumsum([0, 1, 7, 400, 130, 0, 3])])
        scores = rng.normal(size=(begin[-1], 6)).astype(np.float32)
        assert language.viterbi_steps(scores, begin, 2.0).tolist() == language.viterbi_blocks(scores, begin, 2.0).tolist()


def test_long_texts_are_labelled_in_pieces():
    rng = np.random.default_rng(4)
    texts = {"en": EN, "de": DE, "ru": RU}
    table = {x: language.words_of([t]) for x, t in texts.items()}
    counts = np.array([np.bincount(w.grams, minlength=language.BINS) + 0.2 for w in table.values()])
    model = language.Model(list(texts), np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32), np.ones((3, len(language.SCRIPTS) + 1), bool))
    text = "".join(rng.choice(list("  .\n") + [EN, DE, RU, " 12 ", "das ", "the ", "которое "]) for _ in range(300))
    whole = language.label(model, [text])[0]
    for limit in (1, 7, 100, 3000, len(text)):
        got = language.label_long(model, text, limit=limit)
        assert got[0] == whole[0] and got[1] == pytest.approx(whole[1]) and got[2] == whole[2] and "".join(language.cut(text, limit)) == text
    many = language.Model([f"l{k}" for k in range(14)], rng.normal(size=(14, language.BINS)).astype(np.float32), np.ones((14, len(language.SCRIPTS) + 1), bool))
    assert language.label_long(many, text, limit=500)[2] == language.label(many, [text])[0][2]
    assert language.label_long(model, "12 34 " * 9, limit=10) == ("und", 0.0, [])


def test_rejected_documents(spark):
    third = "the dog went with that thing " * 3
    texts = [EN, DE, None, "12 34", third, EN + DE]
    rows = [(k, t, "en" if t == EN else "de") for k, t in enumerate([EN, DE] * 40)]
    df = spark.createDataFrame(rows + [(1000 + k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["lang"] for r in language.keep_identified(df).where("doc_id >= 1000").collect()}
    assert kept == {1000: "en", 1001: "de", 1004: "en", 1005: kept[1005]}
    strict = {r["doc_id"] for r in language.keep_identified(df, 0.9).where("doc_id >= 1000").collect()}
    assert strict == {1000, 1001, 1004}


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 5, 300, 128, 129, 0, 700]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(begin[-1], 3)).astype(np.float32)
    labels = language.viterbi(scores, begin, 2.0)
    for a, b in zip(begin[:-1], begin[1:]):
        if b > a:
            s, path = scores[a:b].astype(float), labels[a:b]
            best = s[0]
            for x in s[1:]:
                best = x + np.maximum(best, best.max() - 2.0)
            assert s[np.arange(b - a), path].sum() - 2.0 * (path[1:] != path[:-1]).sum() == pytest.approx(best.max(), abs=1e-2)


EN = "the quick brown fox and the lazy dog went with that thing which they had when the other one was there "
DE = "der schnelle braune fuchs und die faule katze gingen mit dem ding das sie hatten als der andere nicht da war "
RU = "быстрая лиса и ленивая собака пошли туда где было тепло и светло потому что там хорошо "


def test_language_rows(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(240):
        lang, base = (("en", EN), ("de", DE), ("ru", RU))[k % 3]
        w = base.split()
        rows.append((k, " ".join(rng.choice(w, 30)), lang, "s", 0))
    odd = [(1000 + k, t, "en", None, None) for k, t in enumerate([None, "", "12 !! 34", EN * 3 + DE * 3, EN * 2000, "ψυχή"])]
    df = spark.createDataFrame([*rows, *odd, odd[3], (None, EN, None, None, None)], DOCS).withColumn("lang_pred", F.lit("clash"))
    out = {r["doc_id"]: r for r in language.identify(df).collect()}
    assert all(out[k]["lang_pred"] == lang for k, _, lang, _, _ in rows)
    assert all(out[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(240))
    assert [(out[1000 + k]["lang_pred"], out[1000 + k]["score"]) for k in range(3)] == [("und", 0.0)] * 3
    assert out[1003]["n_spans"] == 2 and out[1004]["lang_pred"] == "en" and 0 <= out[1005]["score"] <= 1 and out[None]["lang_pred"] == "en"
    learn, _ = language.learnable(F.col("doc_id"))
    spans = language.predict(df.where("doc_id = 1003").dropDuplicates(), language.train(df.where(learn))).first()["lang_spans"]
    assert [s["lang"] for s in spans] == ["en", "de"] and abs(spans[0]["end"] - len(EN) * 3) < 30
    kept = language.keep_identified(df.drop("lang_pred"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == df.count() - 3
    assert language.identify(df.limit(0)).count() == 0


# --- licences


def test_license_classifier_on_changed_notices():
    model = licenses.train()
    rng = np.random.default_rng(99)
    filler = "river stone walks under green light".split()
    tried = found = 0
    for family, notices in licenses.NOTICES.items():
        for text in notices:
            for v in [text, *licenses.variants(rng, text, 3, filler)[1:]]:
                batch = pa.RecordBatch.from_arrays([pa.array(["Prose before.\n" + v + "\nprose after"])], names=["text"])
                got = [r for _, _, d, o in kernels.text_chunks(batch) for r in licenses.find(model, d, o)]
                tried += 1
                found += any(r[3] == family for r in got)
    assert found / tried > 0.75
    words = sorted({w for t in licenses.NEAR_MISSES for w in t.split()})
    none = [" ".join(rng.choice(words, 12)) for _ in range(300)] + list(licenses.NEAR_MISSES)
    batch = pa.RecordBatch.from_arrays([pa.array(none)], names=["text"])
    assert sum(len(licenses.find(model, d, o)) for _, _, d, o in kernels.text_chunks(batch)) <= 3


def test_segments_cover_every_word():
    rng = np.random.default_rng(0)
    line = np.repeat(np.arange(9), [1, 59, 60, 61, 90, 91, 1, 300, 7])
    first, end = licenses.segments(np.zeros(len(line)), np.arange(len(line)), line)
    covered = np.zeros(len(line), bool)
    for a, b in zip(first, end):
        assert b > a and b - a <= licenses.WINDOW and line[a] == line[b - 1]
        covered[a:b] = True
    assert covered.all() and (np.diff(first) > 0).all()


def test_license_rows(spark):
    prose = "green river stones " * 2000
    texts = ["é Released under the MIT License.", "All rights reserved.\n" + prose + " Licensed under the Apache License, Version 2.0. " + prose, *ODD]
    df = docs_of(spark, texts, families="clash", spans="clash")
    out = {r["doc_id"]: r for r in licenses.scan(df.union(df.where("doc_id = 0"))).collect()}
    assert out[0]["families"] == "MIT" and out[1]["families"] == "Apache-2.0,proprietary"
    for k in (0, 1):
        for s in out[k]["spans"].split(","):
            family, a, b = s.split(":")
            assert {"MIT": "MIT License", "Apache-2.0": "Apache License", "proprietary": "rights reserved"}[family] in texts[k][int(a) : int(b)]
    assert all(out[k]["spans"] == "" and out[k]["score"] == 0 for k in range(2, len(texts)))
    assert licenses.scan(df.limit(0)).count() == 0


WRAPPED = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy", "of this software and associated documentation files, to deal", "in the Software without restriction."],
    "BSD": ["Redistribution and use in source and binary forms, with or", "without modification, are permitted provided that the following", "conditions are met."],
    "GPL": ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation."],
    "LGPL": ["This library is free software under the terms of", "the GNU Lesser General Public License."],
}


@pytest.mark.parametrize("family", sorted(WRAPPED))
@pytest.mark.parametrize("prefix", ["", " * ", "# ", "// "])
def test_wrapped_notices(family, prefix):
    head, tail = "Green river stones walk under the light.\n\n", "\n\nprose after the notice"
    body = "\r\n".join(prefix + x for x in WRAPPED[family])
    joined = "Green river stones walk.\n" + body + "\nLight walks under the stones."
    for text in (head + body + tail, joined):
        batch = pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])
        spans = [r for _, _, d, o in kernels.text_chunks(batch) for r in licenses.find(licenses.train(), d, o)]
        assert spans and {r[3] for r in spans} == {family}
        assert min(r[1] for r in spans) >= text.index(WRAPPED[family][0]) and max(r[2] for r in spans) <= text.index(WRAPPED[family][-1]) + len(WRAPPED[family][-1])
        assert any("\n" in text[r[1] : r[2]] for r in spans)


# --- quality


def test_forest_learns_and_traversal_agrees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    forest = quality.grow(x[:400], y[:400])
    assert ((forest.score(x[400:]) > 0.5) == y[400:]).mean() > 0.93
    margin = np.full(20, forest.start)
    binned = forest.bins(x[:20])
    for c, b, v in zip(forest.column, forest.bin, forest.value):
        for r in range(20):
            node = 0
            while node < len(c):
                node = 2 * node + (1 if binned[r, c[node]] <= b[node] else 2)
            margin[r] += v[node - len(c)]
    assert np.allclose(forest.score(x[:20]), 1 / (1 + np.exp(-margin)))
    assert np.allclose(quality.grow(x[:0], y[:0]).score(x[:3]), 0.5)


def test_statistics_of_known_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(["Aa b1.\nAa b1.\n", "", None, "é"])], names=["text"])
    x = np.concatenate([quality.statistics(d, o) for _, _, d, o in kernels.text_chunks(batch)])
    at = {n: k for k, n in enumerate(quality.STATISTICS)}
    assert x.shape == (4, len(quality.STATISTICS)) and not x[1].any() and not x[2].any()
    assert x[0, at["distinct_lines"]] == 0.5 and x[0, at["distinct_words"]] == 0.5 and x[0, at["mean_word"]] == 2.5 and x[0, at["upper"]] == 2 / 14
    assert x[3, at["non_ascii"]] == 1


def test_quality_rows(spark):
    rng = np.random.default_rng(0)
    good = lambda: " ".join(rng.choice(EN.split(), 60)) + "."
    bad = lambda: " ".join(w + "###" for w in rng.choice(EN.split(), 60))
    texts = [good() if k % 3 else bad() for k in range(300)] + ODD
    df = docs_of(spark, texts, score="clash", quality="clash")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(0, 0, 0), (None, 1, 0), (5, None, 0), (999_999, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.score_documents(df, labels).collect()}
    assert len(out) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert all(out[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(300))
    held = [k for k in range(300) if out[k]["held_out"]]
    assert np.mean([out[k]["predicted"] == (k % 3 > 0) for k in held]) > 0.95
    assert quality.score_documents(df.limit(0), labels).count() == 0 and quality.score_documents(df, labels.limit(0)).count() == len(texts)


#: Wordings of notices that are none of those that the model learns from.
WORDINGS = {
    "MIT": ["The code in this repository is available under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify."],
    "Apache-2.0": ["Apache License, Version 2.0 applies: you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice."],
    "GPL": ["This file is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."],
    "LGPL": ["This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."],
    "AGPL": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3"],
    "unknown": ["Licensed under the Eclipse Public License 1.0 and nothing else.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear.", "Distributed under the Boost Software License version one."],
}


def test_licences_in_wordings_that_were_not_learnt(spark):
    rng = np.random.default_rng(21)
    prose = [" ".join(rng.choice(EN.split(), 40)) for _ in range(300)]
    rows = [(k, f"{prose[k]}.\n\n{t}\n\n{prose[k + 1]}.") for k, t in enumerate(t for group in WORDINGS.values() for t in group)]
    truth = [f for f, group in WORDINGS.items() for _ in group]
    df = spark.createDataFrame(rows + [(1000 + k, t) for k, t in enumerate([*prose, *licenses.NEAR_MISSES, None, ""])], "doc_id long, text string").withColumn("spans", F.lit("clash"))
    out = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    right = sum(out[k]["families"] == f for k, f in enumerate(truth))
    assert right >= len(truth) - 1, [(f, out[k]["families"]) for k, f in enumerate(truth)]
    assert sum(out[k]["n_spans"] for k in out if k >= 1000) <= 1
    assert licenses.scan(df.limit(0)).count() == 0


def test_spans_count_code_points_and_hide_the_less_specific():
    text = "é日𝒳 GPL".encode()
    assert licenses.code_points(np.frombuffer(text, np.uint8), [0, 2, 5, 9, 10, len(text)]) == {0: 0, 2: 1, 5: 2, 9: 3, 10: 4, len(text): 7}
    assert licenses.joined([(0, 9, "GPL", 0.9), (5, 20, "LGPL", 0.6), (30, 40, "GPL", 0.7), (38, 50, "GPL", 0.8)]) == [(5, 20, "LGPL", 0.6), (30, 50, "GPL", 0.8)]


def test_registered_queries():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 13)]


# --- planted secrets


def test_planted_keys_that_no_pattern_covers(spark):
    rng = np.random.default_rng(11)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text is not null").collect()
    planted = {}
    rows = []
    for k, r in enumerate(docs):
        key = "".join(rng.choice(letters, int(rng.integers(24, 48)))) if k % 2 else None
        if k % 6 == 1:
            key = "".join(rng.choice(list("0123456789ABCDEF"), 40))
        text = r["text"] if key is None else f"{r['text']} see {key} now"
        planted[r["doc_id"]] = None if key is None else (len(r["text"]) + 5, len(r["text"]) + 5 + len(key))
        rows.append((r["doc_id"], text))
    out = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = false = 0
    for i, place in planted.items():
        spans = [s.split(":") for s in out[i]["spans"].split(",") if s.startswith("entropy")]
        inside = [s for s in spans if place and place[0] <= int(s[1]) and int(s[2]) <= place[1] and 2 * (int(s[2]) - int(s[1])) >= place[1] - place[0]]
        found += bool(inside)
        false += len(spans) - len(inside)
    n = sum(p is not None for p in planted.values())
    assert found >= 0.97 * n and false <= 0.01 * len(rows)


def test_a_placeholder_clears_only_itself():
    key = "9fK2mPq7Rt4Zx8Bv3Nc6Wd1L"
    _, spans = secrets.secret_spans(f"/repos/example-{key}")
    assert any(kind == "entropy_base64" for _, _, kind in spans)
    assert not [s for s in secrets.secret_spans("see 123E4567-E89B-12D3-A456-426614174000 and exampleEXAMPLEexample0123456789")[1] if s[2].startswith("entropy")]


def test_many_secrets_cost_time_in_proportion():
    rng = np.random.default_rng(1)
    dump = lambda n: " ".join("".join(rng.choice(list("0123456789ABCDEF"), 32)) for _ in range(n))
    small, large = dump(1500), dump(6000)
    clock = lambda t: min(timeit.repeat(lambda: secrets.secret_spans(t), number=1, repeat=3))
    assert clock(large) < 8 * clock(small)
    assert len(secrets.secret_spans(small)[1]) > 1300


def test_unknown_tokenizer_parts_are_errors(tmp_path):
    spec = json.load(open(VOCABULARY, encoding="utf-8"))
    bpe.require_supported(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": {**spec["model"], "byte_fallback": True}}):
        with pytest.raises(ValueError, match="not implemented"):
            bpe.require_supported({**spec, **change})


def test_one_hot_document_teaches_once(spark):
    docs = spark.createDataFrame([(1, f"hot text number {k} " * 5) for k in range(200)] + [(k, f"plain words {k} " * 9) for k in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)], "doc_id long, quality int")
    out = quality.score_documents(docs, labels).collect()
    assert len(out) == 258 and all(0 <= r["score"] <= 1 for r in out)
