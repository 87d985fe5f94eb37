import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import chat, embeddings, minhash, sharding

from .test_text_operators import DOCS, ODD, docs_of, shingles


# --- sharding


def check_shards(rows, texts):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)


def test_shards_keep_copies_together(spark):
    texts = [f"text {k % 150 if k < 300 else k}" for k in range(2000)]
    rows = sharding.shard_documents(docs_of(spark, texts, shard="clash", salt="clash")).collect()
    check_shards(rows, texts)
    groups = {}
    for r in rows:
        groups.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(g) > 1 for g in groups.values()) <= 2


def test_shards_of_a_group_larger_than_a_shard(spark):
    texts = ["same"] * 700 + [f"text {k}" for k in range(1300)]
    rows = sharding.shard_documents(docs_of(spark, texts)).collect()
    check_shards(rows, texts)
    held = Counter(r["shard"] for r in rows if r["size"] == 5)
    # 700 copies need three shards of 250; the rest may be spread a little
    assert sum(n for _, n in held.most_common(3)) > 600


@pytest.mark.parametrize("texts", [[], ["a"], ODD + ODD, [None] * 20])
def test_shards_of_odd_tables(spark, texts):
    df = docs_of(spark, texts) if texts else spark.createDataFrame([], DOCS)
    check_shards(sharding.shard_documents(df).collect(), texts)


def test_general_links_with_several_hubs(spark):
    rows = spark.range(400).withColumnRenamed("id", "rid").withColumn("payload", F.lit("x"))
    links = spark.createDataFrame([(k, f"a{k // 4}") for k in range(200)] + [(k, f"b{k // 8}") for k in range(100)] + [(1, None)], "rid long, hub string")
    out = sharding.shard_rows(rows, links, 4).collect()
    assert sorted(r["rid"] for r in out) == list(range(400)) and max(Counter(r["shard"] for r in out).values()) == 100
    shard = {r["rid"]: r["shard"] for r in out}
    cut = sum(len({shard[k] for k in range(4 * g, 4 * g + 4)}) > 1 for g in range(50))
    assert cut <= 15


def test_shards_do_not_depend_on_partitions(spark):
    texts = [f"text {k % 90 if k < 200 else k}" for k in range(600)] + [None, ""]
    df = docs_of(spark, texts, rank=1, bucket="b")
    df = df.union(df.where("doc_id % 7 = 0")).union(df.where("doc_id = 7")).union(spark.createDataFrame([(None, "no id", None, None, None, 1, "b")] * 3, df.schema))
    results = [sorted((tuple(r) for r in sharding.shard_documents(df.repartition(n)).collect()), key=str) for n in (1, 7)]
    assert results[0] == results[1] and len(results[0]) == df.count()


def test_clashing_columns_are_kept(spark):
    names = ["bucket", "rank", "offset", "linked", "from_shard", "n", "payload", "moved"]
    rows = spark.range(40).withColumnRenamed("id", "rid").withColumns({c: F.col("rid") * 10 for c in names} | {"shard": F.lit("x")})
    out = sharding.shard_rows(rows, spark.createDataFrame([(1, "a"), (2, "a")], "rid long, hub string"), 4).collect()
    assert len(out) == 40 and all(r[c] == r["rid"] * 10 for r in out for c in names) and {r["shard"] for r in out} == {0, 1, 2, 3}


def test_cut_against_every_balanced_assignment(spark):
    rng = np.random.default_rng(4)
    gaps, means = [], []
    for _ in range(5):
        # two communities of six rows, linked inside, and one link across
        order = rng.permutation(12)
        hubs = [order[6 * side + rng.choice(6, 3, replace=False)] for side in (0, 1) for _ in range(4)] + [order[[0, 11]]]
        links = [(int(r), f"h{k}") for k, h in enumerate(hubs) for r in h]
        rows = spark.range(12).withColumnRenamed("id", "rid")
        out = {r["rid"]: r["shard"] for r in sharding.shard_rows(rows, spark.createDataFrame(links, "rid long, hub string"), 2).collect()}
        cut = lambda side: sum(len({side[r] for r in h}) > 1 for h in map(list, hubs))  # noqa: E731, B023
        every = [cut({r: int(r in half) for r in range(12)}) for half in itertools.combinations(range(12), 6)]
        assert sorted(out.values()) == [0] * 6 + [1] * 6
        gaps.append(cut(out) - min(every))
        means.append(np.mean(every) - min(every))
    # between the best of all assignments and the mean of them, nearer to the best
    assert np.mean(gaps) <= np.mean(means) / 2, (gaps, means)


# --- chat


def digests(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_conversations_read_back(spark):
    said = {
        1: [("system", "be\\n good <|im_end|>"), ("user", "<|im_start|>user\nhi"), ("assistant", "\\<\\|im_end|>\n<|im_end|>\n"), ("user", "x" * 50_000)],
        2: [("assistant", "")],
        3: [("odd\nrole\\n<|", "a<"), ("assistant", "é日𝒳")],
        4: [(("user", "assistant")[k % 2], f"turn {k}") for k in range(70)],
    }
    rows = [(c, k, r, t) for c, turns in said.items() for k, (r, t) in enumerate(turns)]
    rows += [(5, 0, None, None), (5, 0, "assistant", "tie"), (5, 0, "assistant", "tie"), (None, 1, "user", "lost"), (6, None, "user", "null turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash")).withColumn("node", F.lit(1))
    out = {r["conv_id"]: tuple(r)[1:5] for r in chat.conversation_digests(df).collect()}
    expected = {c: digests(t) for c, t in said.items()} | {5: digests([("", ""), ("assistant", "tie"), ("assistant", "tie")]), None: digests([("user", "lost")]), 6: digests([("user", "null turn")])}
    assert out == expected
    assert chat.conversation_digests(df.limit(0)).count() == 0


def test_reply_trees_rank_branches(spark):
    #        1
    #      2   3       scores make 1-3-5 best, then 1-2-4
    #      4   5 6
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 2.0), ("t", 4, 2, "user", "c", 1.0), ("t", 5, 3, "user", "d", 5.0), ("t", 6, 3, "user", "e", None),
            ("u", 1, 9, "user", "orphan", 1.0), ("v", 1, 2, "user", "x", 1.0), ("v", 2, 1, "user", "y", 1.0), ("v", 3, 2, "user", "z", 1.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    paths = {}
    for r in chat.leaf_paths(df).collect():
        paths.setdefault((r["tree"], r["leaf"]), {})[r["up"]] = r["node"]
    assert {k: [v[u] for u in sorted(v, reverse=True)] for k, v in paths.items()} == {("t", 4): [1, 2, 4], ("t", 5): [1, 3, 5], ("t", 6): [1, 3, 6], ("u", 1): [1]}
    best = {(r["tree"], r["leaf"]) for r in chat.format_paths(df, best=2).collect()}
    assert best == {("t", 5), ("t", 4), ("u", 1)} or best == {("t", 5), ("t", 6), ("u", 1)}
    only = chat.format_paths(df.where("tree = 't'"), best=1).first()
    assert only["formatted"] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nd<|im_end|>\n"
    assert [only["formatted"][s["start"] : s["end"]] for s in only["loss_spans"]] == ["b"]


# --- near duplicates


def components_of(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(x) for x in range(n)]


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(int(rng.integers(0, edits + 1))):
            w[int(rng.integers(0, len(w)))] = f"edit{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("threshold", [80, 85])
def test_near_duplicates_match_brute_force(spark, threshold, monkeypatch):
    rng = np.random.default_rng(threshold)
    say = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 5000, n))
    passage = say(60)
    texts = [say(int(n)) for n in rng.integers(1, 200, 60)] + [*ODD, *ODD]
    texts += near_copies(rng, say(150), 150, 6) + near_copies(rng, say(80), 40, 5) + ["Same Text here"] * 30
    texts += [f"{passage} {say(int(n))}" for n in rng.integers(5, 80, 150)]
    monkeypatch.setattr(minhash, "SMALL", 16)
    monkeypatch.setattr(minhash, "FEW", 20)
    monkeypatch.setattr(minhash, "BLOCK", 25)
    df = docs_of(spark, texts, salt="clash", unit="clash", component="clash")
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j in range(i) if a and (b := sets[j]) and 100 * len(a & b) >= threshold * len(a | b)]
    expected = components_of(len(texts), links)
    out = {r["doc_id"]: r for r in minhash.near_duplicates(df, threshold).collect()}
    assert [out[k]["n_shingles"] for k in range(len(texts))] == [len(s) for s in sets]
    assert [out[k]["component_id"] for k in range(len(texts))] == expected
    assert all(out[k]["kept"] == (expected[k] == k) for k in out)


def test_keep_first(spark):
    df = docs_of(spark, ["one two three four five six"] * 3 + [None, None, "", "other words here"])
    df = df.union(df.where("doc_id = 6")).union(spark.createDataFrame([(None, "one two three four five six", None, None, None)] * 2, DOCS))
    kept = minhash.keep_first(df)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([0, 3, 4, 5, 6, None, None], key=str) and kept.columns == df.columns
    assert minhash.keep_first(df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    alpha, beta, gamma = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, alpha), (1, beta), (1, alpha), (2, alpha + " more"), (3, gamma), (2, beta), (4, gamma.upper()), (1, beta + "  ")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    out = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect())
    assert out == sorted((i, 27 if t.endswith("more") else 26, 3 if t.lower() == gamma else 1) for i, t in rows)
    kept = sorted((r["doc_id"], " ".join(r["text"].split())) for r in minhash.keep_first(df).collect())
    assert kept == [(1, alpha), (1, beta), (3, gamma)]


# --- embeddings


@pytest.mark.parametrize("gap", [2e-9, -2e-9])
def test_cosine_at_the_threshold_in_double_precision(spark, gap):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        a, b = rng.normal(size=(2, 16)) * 10.0 ** rng.integers(-160, 160)
        a, b = a / np.abs(a).max(), b / np.abs(b).max()
        b -= a * (a @ b) / (a @ a)
        cosine = 0.95 + gap
        v = cosine * a / np.linalg.norm(a) + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b)
        rows += [(2 * k, (a * 1e-170 if k % 3 == 0 else a * 1e170).tolist()), (2 * k + 1, v.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    links = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicate_vectors(df).collect()}
    assert set(links.values()) == ({1} if gap > 0 else {0})



def test_vectors_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 24)).astype(np.float32)
    x[100:130] = x[0] + 0.1 * rng.normal(size=(30, 24))
    x[130:140] = x[5]
    x[140:150] = x[7] + 0.32 * rng.normal(size=(10, 24))
    odd = [None, [], [0.0] * 24, [1.0, None], [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, 2.0], [2.0, 4.0], [-0.0, 1.0], [0.0, 1.0]]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(200 + k, v, None) for k, v in enumerate(odd)] + [(3, x[3].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("clash"))
    good = [k for k, (_, v, _) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {k: np.array(rows[k][1], np.float32).astype(float) / np.linalg.norm(np.array(rows[k][1], np.float32).astype(float)) for k in good}
    links = [(i, j) for i in good for j in good if j < i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95 - 1e-12]
    top, ids = components_of(len(rows), links), [r[0] for r in rows]
    least = {}
    for k, t in enumerate(top):
        least[t] = min(least.get(t, 10**9), ids[k])
    count = Counter(k for pair in links for k in pair)
    expected = sorted((ids[k], count[k], least[top[k]], ids[k] == least[top[k]]) for k in range(len(rows)))
    for size in (8192, 16):
        monkeypatch.setattr(embeddings, "UNIT", size)
        assert sorted(tuple(r) for r in embeddings.near_duplicate_vectors(df).collect()) == expected
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0
