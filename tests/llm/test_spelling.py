import collections
import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import spelling

DOCS = "doc_id long, text string, lang string, word string, n long"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows, least_count=5):
    """Counts, near words, forms and roots, from their definition."""
    n = collections.Counter()
    for doc, text in rows:
        for keep, run in itertools.groupby(text or "", lambda c: "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ"):
            if keep:
                w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
                w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w
                n[w] += len(w) >= 6
    n = {w: k for w, k in n.items() if k >= least_count}
    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(by[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(by[w]), None if form[w] is None else n[form[w]]))
    return out


def pairs_of(words, pieces):
    """Near pairs of words through the kernel, all words cut in so many pieces."""
    rows = []
    for w in words:
        for m in {len(w), len(w) - 1} - {0}:
            cuts = sorted({m * j // pieces for j in range(pieces + 1)})
            rows += [(hash((m, lo, hi, w[:lo], w[len(w) - (m - hi) :])), m, lo, hi, w) for lo, hi in zip(cuts, cuts[1:])]
    rows.sort()
    table = pa.table({c: pa.array([r[k] for r in rows], pa.string() if c == "word" else pa.int64()) for k, c in enumerate(("unit", "m", "lo", "hi", "word"))})
    a, b = spelling.near_words(table)
    return [(rows[i][4], rows[j][4]) for i, j in zip(a, b)]


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=7), min_size=1, max_size=60), st.integers(1, 7))
def test_each_near_pair_is_found_once_whatever_the_pieces(words, pieces):
    found = pairs_of(words, pieces)
    assert collections.Counter(frozenset(p) for p in found) == {frozenset(p): 1 for p in itertools.combinations(words, 2) if near(*p)}


def corpus(rng, n):
    stems = ["".join(rng.choice(list("abcé"), 7)) for _ in range(12)]
    texts = []
    for _ in range(n):
        some = [s if rng.random() < 0.7 else s[:k] + rng.choice(["", "x", "É", s[k] * 2]) + s[k + 1 :] for s in rng.choice(stems, 40) for k in [rng.integers(7)]]
        texts.append(" ".join(some))
    return [*enumerate(texts), (n, None), (n + 1, ""), (n + 2, "×÷Àbcdefg-ÀBCDEFG " * 6), (n + 2, "×÷Àbcdefg-ÀBCDEFG " * 6), (None, "Lonelyword " * 5), (n + 3, "z" * 50_000 + " abcabcab_" * 30_000)]


@pytest.mark.parametrize("most", [spelling.UNIT, 3])
def test_variants_match_the_definition(spark, most):
    rows = corpus(np.random.default_rng(1), 60)
    df = spark.createDataFrame([(*r, "en", "clash", 0) for r in rows], DOCS).repartition(3)
    got = [tuple(r) for r in spelling.variants(df, most=most).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    assert any(r[1] for r in got)


def test_chains_end_at_their_last_word(spark):
    words = ["abcdefg", "abcdefx", "abcdeyx", "abcdzyx"]
    rows = [(1, " ".join(w for k, w in enumerate(words) for _ in range(5 * 6**k)))]
    df = spark.createDataFrame([(*r, "en", "", 0) for r in rows], DOCS)
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(df).collect()}
    assert got == {words[0]: (words[1], words[3]), words[1]: (words[2], words[3]), words[2]: (words[3], words[3]), words[3]: (None, words[3])}
    assert spelling.variants(df.limit(0)).count() == 0


def test_ties_and_the_factor(spark):
    rows = [(1, "stones " * 25 + "stonez " * 25 + "stonex " * 5 + "stoney " * 6)]
    got = {r["word"]: (r["form"], r["n_near"]) for r in spelling.variants(spark.createDataFrame([(*r, "en", "", 0) for r in rows], DOCS)).collect()}
    assert got == {"stones": (None, 3), "stonez": (None, 3), "stonex": ("stones", 3), "stoney": (None, 3)}


def test_units_of_one_prefix_are_split(spark):
    """A third of the vocabulary behind one prefix: no unit keeps more rows than the letters of a piece allow."""
    words = ["".join(p) for p in itertools.product("abcde", repeat=5)]
    df = spark.createDataFrame([("prefix" + w + "suffix", 1) for w in words], "word string, n long")
    rows = spelling.units(df, most=200)
    assert rows.groupBy("unit").count().agg(F.max("count")).first()[0] <= 200
    assert {r["m"]: r["n"] for r in rows.groupBy("m").agg(F.count_distinct("word").alias("n")).collect()} == {17: len(words), 16: len(words)}
