import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqloom.llm import language, secrets

from .test_graph_operators import components_of
from .test_text_operators import DOCS, ODD, VOCABULARY, docs_of, shingles

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_run_matches_brute_force(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{D}/documents.parquet' ORDER BY doc_id").fetchall()
    sources = dict(duckdb.sql(f"SELECT doc_id, source FROM '{D}/documents.parquet'").fetchall())
    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{D}/benchmark.parquet'").fetchall()]
    model = language.train(spark.read.parquet(f"{D}/documents.parquet").where("lang is not null").where(language.learnable(F.col("doc_id"))[0]))
    labels = {i: language.label(model, [t])[0] for i, t in docs if t}
    docs = [(i, t) for i, t in docs if i in labels and labels[i][1] >= language.LEAST_SHARE]
    sets = [shingles(t) for _, t in docs]
    links = [(i, j) for i, a in enumerate(sets) for j in range(i) if (b := sets[j]) and 100 * len(a & b) >= 80 * len(a | b)]
    docs = [d for k, d in enumerate(docs) if components_of(len(docs), links)[k] == k]
    clean = lambda t: shingles(re.sub(r"[^0-9a-zA-Z\u0080-\U0010ffff]", " ", t))
    tests = [clean(t) for t in items]
    docs = [(i, t) for i, t in docs if not any(q and 100 * len(q & s) >= 80 * len(q) for s in [clean(t)] for q in tests)]
    expected = {}
    for i, t in docs:
        t = secrets.mask(t)
        ids = library.encode(t, add_special_tokens=False).ids
        expected[i] = (labels[i][0], sources[i], ids, len(ids), hashlib.sha256(t.encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in corpus_pipeline.run(spark, D).collect()}
    assert got == expected and 0 < len(got) < 200
    # The first stage's predictions reach the output, and they are right: a model that guesses would not pass.
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{D}/documents.parquet' WHERE lang IS NOT NULL").fetchall())
    held = [i for i in got if i in truth and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 20 and sum(got[i][0] == truth[i] for i in held) >= 0.95 * len(held)


def test_stages_on_odd_tables(spark, tmp_path):
    bench = spark.createDataFrame([(0, None), (1, "")], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = docs_of(spark, [*ODD, "token=abcdefgh and words of a text"])
    rows = rows.union(rows).union(spark.createDataFrame([(None, "no id here", None, None, None)], DOCS))
    for docs in (rows, rows.limit(0), rows.withColumns({"leaks": F.lit(1), "salt": F.lit("x"), "kept": F.lit(True), "ids": F.lit(0)})):
        columns, n = docs.columns, docs.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.mode("overwrite").parquet(str(tmp_path / f"out{n}{len(columns)}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"out{n}{len(columns)}{k}"))
            if k < 4:
                assert docs.columns == columns
        if n:
            letters = [k for k, t in enumerate(ODD) if t and any(c.isalpha() for c in t)] + [len(ODD)]
            assert sorted((r["doc_id"] for r in docs.collect()), key=str) == sorted([*letters, None], key=str)
        else:
            assert docs.count() == 0


def test_masks_take_effect(spark):
    out = corpus_pipeline.mask_secrets(spark, docs_of(spark, ["token=abcdefgh x"]), "")
    assert out.first()["text"] == "[SECRET] x" and out.first()["n_chars"] == 10
    assert np.array_equal(corpus_pipeline.tokenize(spark, out, "").first()["ids"], corpus_pipeline.tokenize(spark, docs_of(spark, ["[SECRET] x"]), "").first()["ids"])
