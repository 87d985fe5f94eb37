import collections
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import lcs, residues, vectors
from seqloom.operators import align, allocation, distributions, learn, ranking, reports, selection, sets, similarity, tables, validate
from seqloom.plans import catalogue


def frame(spark, seqs):
    return spark.createDataFrame([(s,) for s in seqs], "seq string")


def random_seqs(n, seed=0, letters="ACDE"):
    rng = np.random.default_rng(seed)
    return sorted({"".join(rng.choice(list(letters), rng.integers(8, 16))) for _ in range(n)})


def ratios(a, b):
    return {(x, y): 2 * lcs.lcs_long(x, y) / (len(x) + len(y)) for x in a for y in b}


def test_percentiles(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (1.0,), (2.0,)], "x double")
    assert sorted((r["x"], r["p"]) for r in ranking.percentile_rank(df, "x", "p").collect()) == [(1.0, 0.25), (1.0, 0.25), (2.0, 0.625), (3.0, 0.875)]
    with pytest.raises(Exception, match="nonfinite"):
        ranking.percentile_rank(spark.createDataFrame([(1.0,), (float("nan"),)], "x double"), "x", "p").collect()


@pytest.mark.parametrize("chunk", [2048, 7])
def test_similarity_joins(spark, chunk):
    a, b = random_seqs(40), random_seqs(30, 1)
    r = ratios(a, b)
    got = {(x["a"], x["b"]) for x in similarity.pairs_at_least(frame(spark, a), frame(spark, b), chunk=chunk).collect()}
    assert got == {p for p, v in r.items() if v >= 0.8 - 1e-12}
    best = {x["seq"]: 2 * x["best_lcs"] / x["best_total"] for x in similarity.max_similarity(frame(spark, a), frame(spark, b), chunk=chunk).collect()}
    assert best == pytest.approx({x: max(r[x, y] for y in b) for x in a})


def test_max_similarity_of_a_large_reference(spark, monkeypatch):
    a, b = random_seqs(25), random_seqs(30, 1)
    small = {tuple(x) for x in similarity.max_similarity(frame(spark, a), frame(spark, b)).collect()}
    monkeypatch.setattr(similarity, "SMALL_LETTERS", 1)
    assert {tuple(x) for x in similarity.max_similarity(frame(spark, a), frame(spark, b), chunk=4).collect()} == small
    with pytest.raises(ValueError, match="empty"):
        similarity.max_similarity(frame(spark, a), frame(spark, []))


def test_boundary_of_neighbors(spark):
    ten = "A" * 10
    df = frame(spark, [ten, "A" * 8 + "CC", "A" * 9 + "C"])
    edges = {tuple(sorted((r["a"], r["b"]))) for r in similarity.similarity_edges(df, strict=True).collect()}
    assert tuple(sorted((ten, "A" * 8 + "CC"))) not in edges and tuple(sorted((ten, "A" * 9 + "C"))) in edges
    assert len(similarity.similarity_edges(df).collect()) == 3


def test_families_and_clusters(spark):
    seqs = random_seqs(60)
    r = ratios(seqs, seqs)
    up = {s: s for s in seqs}

    def top(s):
        while up[s] != s:
            s = up[s]
        return s

    for (x, y), v in r.items():
        if v >= 0.8 - 1e-12:
            a, b = sorted((top(x), top(y)))
            up[b] = a
    assert {x["seq"]: x["family"] for x in similarity.families(frame(spark, seqs)).collect()} == {s: top(s) for s in seqs}
    chosen, expected = [], {}
    for s in seqs:
        near = [c for c in chosen if r[s, c] >= 0.8 - 1e-12]
        if near:
            expected[s] = max(near, key=lambda c: (r[s, c], -chosen.index(c)))
        else:
            chosen.append(s)
            expected[s] = s
    assert {x["seq"]: x["representative"] for x in similarity.greedy_clusters(frame(spark, seqs)).collect()} == expected


def test_long_strings_meet_short_ones(spark):
    """Equal strings of 40,000 letters are a pair, and one of a million among short ones costs its own length only."""
    long = "ACDE" * 10_000
    near = "C" + long[1:]
    a, b = lcs.Strings([long, "AAAA"]), lcs.Strings([long, near, "CCCC"])
    assert {(i, j) for i, j, _ in zip(*lcs.near_pairs(a, b, 80))} == {(0, 0), (0, 1)}
    giant = "ACDEFGHIKL" * 100_000
    seqs = random_seqs(300)
    table = lcs.Strings([*seqs, giant])
    assert sum(x.nbytes for x in (table.codes, table.size, table.start)) < 2 * len(giant)
    got = {frozenset((table.strings[i], table.strings[j])) for i, j, _ in zip(*lcs.near_pairs(table, None, 80))}
    assert got == {frozenset(p) for p, v in ratios(seqs, seqs).items() if p[0] != p[1] and v >= 0.8 - 1e-12}
    best = similarity.max_similarity(frame(spark, seqs[:20]), frame(spark, [giant, *seqs[20:]]))
    r = ratios(seqs[:20], seqs[20:])
    assert {x["seq"]: x["best"] for x in best.collect()} == {s: min(seqs[20:], key=lambda t: (-r[s, t], t)) for s in seqs[:20]}


@pytest.mark.parametrize("own", [False, True])
def test_bests_by_waves_match_all_pairs(own):
    rng = np.random.default_rng(11)
    draw = lambda n, letters: sorted({"".join(rng.choice(list(letters), rng.integers(1, 90))) for _ in range(n)})
    a, b = draw(60, "ACDEF"), draw(300, "ACD")
    b = a if own else b
    r = ratios(a, b)
    x = lcs.Strings(a)
    y = x if own else lcs.Strings(b)
    i, j, n = lcs.best_pairs(x, y, np.arange(len(a)), lcs.Shared(x, y), own, 0.7)
    found = {(a[p], b[q]): 2 * k / (len(a[p]) + len(b[q])) for p, q, k in zip(i, j, n)}
    assert len(found) == len(i) and all(r[p] == pytest.approx(v) for p, v in found.items())
    for s in a:
        others = {t: r[s, t] for t in b if not own or s != t}
        top = max(others.values())
        assert {t for t, v in others.items() if v >= min(top, 0.7)} <= {t for p, t in found if p == s}


@pytest.mark.parametrize("finish", [200_000, 3, 0])
def test_followers_in_rounds(spark, monkeypatch, finish):
    monkeypatch.setattr(similarity, "FINISH", finish)
    rng = np.random.default_rng(12)
    nodes = [f"n{k:03d}" for k in range(80)]
    edges = {tuple(sorted(rng.choice(nodes, 2, replace=False))) for _ in range(120)} | {("n000", n) for n in nodes[1:40]} | set(zip(nodes[60:70], nodes[61:71]))
    fell = set()
    for n in nodes:
        if any(a not in fell for a, b in edges if b == n):
            fell.add(n)
    got = [r["seq"] for r in similarity.followers(spark.createDataFrame(sorted(edges), "a string, b string")).collect()]
    assert len(got) == len(set(got)) and set(got) == fell
    assert similarity.followers(spark.createDataFrame([], "a string, b string")).count() == 0


def test_top_exclusive(spark):
    seqs = random_seqs(60)
    top = similarity.top_exclusive(frame(spark, seqs), 10, order=("seq",))
    assert len(top) == 10 and all(v <= 0.8 for (a, b), v in ratios(top, top).items() if a != b)
    # One after the other, as the definition says, in an order that is not that of the strings; repeats count once.
    score = {s: (hash((s[::-1], 7)) % 10, s) for s in seqs}
    taken = []
    for s in sorted(seqs, key=score.get):
        if not any(v > 0.8 + 1e-12 for v in ratios([s], taken).values()):
            taken.append(s)
    ranked = spark.createDataFrame([(s, score[s][0]) for s in seqs + seqs[:9]], "seq string, x int").repartition(3)
    assert [r["seq"] for r in similarity.exclusive(ranked, ("x", "seq")).orderBy("at").collect()] == taken and len(taken) < len(seqs)
    with pytest.raises(ValueError, match="only"):
        similarity.top_exclusive(frame(spark, seqs[:3]), 10, order=("seq",))


def test_crowding(spark):
    seqs = random_seqs(40)
    r = ratios(seqs, seqs)
    got = {x["seq"]: x["crowding"] for x in similarity.crowding(frame(spark, seqs), frame(spark, seqs[:10])).collect()}
    for s in seqs:
        others = [t for t in seqs[:10] if t != s]
        assert got[s] == pytest.approx(sum(r[s, t] > 0.8 for t in others) / len(others))


@pytest.mark.parametrize("finish", [200_000, 60, 0])
def test_components(spark, monkeypatch, finish):
    monkeypatch.setattr(tables, "FINISH", finish)
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(k, k + 1) for k in range(300, 380)] + [(500, k) for k in range(501, 600)]
    up = list(range(700))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    got = {r["node"]: r["component"] for r in tables.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}
    assert tables.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_split_keeps_families(spark):
    rng = np.random.default_rng(2)
    rows = [(f"s{k}", f"f{rng.integers(0, 60)}", int(rng.random() < 0.3)) for k in range(400)]
    df = spark.createDataFrame(rows, "seq string, family string, label int")
    out = {r["seq"]: r["split"] for r in allocation.split_families(df, {"train": 0.8, "dev": 0.1, "audit": 0.1}).collect()}
    assert len(out) == 400
    by = {}
    for s, f, _ in rows:
        by.setdefault(f, set()).add(out[s])
    assert all(len(x) == 1 for x in by.values())
    assert sum(v == "train" for v in out.values()) == pytest.approx(320, abs=12)


def test_distances(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(30, 4)), rng.normal(0.5, 1, size=(40, 4))
    frame_of = lambda z, at: spark.createDataFrame([(at + k, v.tolist()) for k, v in enumerate(z)], "id long, embedding array<double>")
    fx, fy = frame_of(x, 0), frame_of(y, 1000)
    d = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(axis=2)
    k = lambda m: np.exp(-m / 2)
    off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    assert distributions.mmd_unbiased(fx, fy, 1.0) == pytest.approx(off(k(d(x, x))) + off(k(d(y, y))) - 2 * k(d(x, y)).mean())
    rx, ry = np.sort(d(x, x), axis=1)[:, 3], np.sort(d(y, y), axis=1)[:, 3]
    p, r = distributions.precision_recall(fx, fy)
    assert p == pytest.approx((d(x, y) <= ry[None]).any(axis=1).mean()) and r == pytest.approx((d(x, y) <= rx[:, None]).any(axis=0).mean())
    upper = d(x, x)[np.triu_indices(30, 1)]
    assert distributions.median_squared_distance(fx) == pytest.approx(np.median(upper))
    assert np.allclose(distributions.moments(fx).covariance, np.cov(x, rowvar=False))
    assert distributions.frechet_distance(fx, fx) == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("chunk", [1024, 90])
def test_neighbours_by_pivots(spark, chunk):
    """Equal to all pairs on clusters of unequal size (one holds a third), lone vectors and copies; on clusters, few pairs meet."""
    rng = np.random.default_rng(14)
    centres = rng.normal(size=(40, 6)) * 30
    sizes = [900] + [45] * 39
    x = np.concatenate([np.repeat(centres, sizes, axis=0) + rng.normal(size=(sum(sizes), 6)), rng.normal(size=(5, 6)) * 500, np.zeros((6, 6))])
    y = centres[rng.integers(0, 40, 600)] + rng.normal(size=(600, 6)) * 3
    frame_of = lambda z, at: spark.createDataFrame([(at + k, v.tolist()) for k, v in enumerate(z)], "id long, embedding array<double>")
    fx, fy = frame_of(x, 0), frame_of(y, 10_000)
    d = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(axis=2)
    for k in (1, 3):
        radius = {r["id"]: r["radius2"] for r in distributions.knn_radius(fx, k, chunk).collect()}
        assert np.allclose([radius[i] for i in range(len(x))], np.sort(d(x, x), axis=1)[:, k], atol=1e-12)
    rx, ry = np.sort(d(x, x), axis=1)[:, 3], np.sort(d(y, y), axis=1)[:, 3]
    assert distributions.covered(fy, fx, 3, chunk) == pytest.approx((d(y, x) <= rx[None]).any(axis=1).mean())
    assert distributions.covered(fx, fy, 3, chunk) == pytest.approx((d(x, y) <= ry[None]).any(axis=1).mean())
    sides = distributions.knn_units(fx, 3, chunk).groupBy("unit").agg(F.count_if(F.col("side") == 0).alias("q"), F.count_if(F.col("side") == 1).alias("b"))
    compared = sides.agg(F.sum(F.col("q") * F.col("b"))).first()[0]
    own = sum(n * n for n in sizes)
    assert compared < 1.6 * own + 0.1 * len(x) ** 2
    even = frame_of(np.repeat(centres, 45, axis=0) + rng.normal(size=(1800, 6)), 0)
    sides = distributions.knn_units(even, 3, chunk).groupBy("unit").agg(F.count_if(F.col("side") == 0).alias("q"), F.count_if(F.col("side") == 1).alias("b"))
    assert sides.agg(F.sum(F.col("q") * F.col("b"))).first()[0] < 0.1 * 1800**2
    assert distributions.knn_radius(frame_of(x[:2], 0), 3).where("radius2 IS NOT NULL").count() == 0


def test_wasserstein_of_equal_samples_is_zero(spark):
    df = spark.createDataFrame([(float(k % 7),) for k in range(50)], "x double")
    assert distributions.wasserstein(df, df, "x").first()[0] == pytest.approx(0)
    shifted = df.withColumn("x", F.col("x") + 1)
    assert distributions.wasserstein(shifted, df, "x").first()[0] == pytest.approx(1 / np.std([k % 7 for k in range(50)]))


def test_merge_and_scores(spark):
    a, b = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, x double"), spark.createDataFrame([(1, 5.0), (3, 1.0)], "k int, y double")
    with pytest.raises(Exception, match="one table only"):
        sets.merge_tables(a, b, "k").collect()
    with pytest.raises(ValueError, match="both"):
        sets.merge_tables(a, a, "k")
    with pytest.raises(Exception, match="no y"):
        sets.join_scores(a.withColumn("k", F.col("k").cast("string")), b.withColumn("k", F.col("k").cast("string")), "k").collect()


def test_accumulate(spark):
    pool, added = sets.accumulate(frame(spark, ["A"]), [frame(spark, ["A", "B"]), frame(spark, ["C", "K"]), frame(spark, ["D"])], 3, known=frame(spark, ["K"]))
    assert added == [1, 1] and sorted(r[0] for r in pool.collect()) == ["A", "B", "C"]


def test_validators(spark):
    def errors(seqs, count=None, header="h"):
        df = spark.createDataFrame([(k + 1, header, s) for k, s in enumerate(seqs)], "record long, header string, seq string")
        return sorted(r["error"] for r in validate.library_errors(df, count).collect())

    assert errors(["A" * 8, "C" * 50], 2) == []
    assert errors([], 2) == ["count 0"]
    assert errors(["A" * 8, "A" * 8]) == ["duplicate", "duplicate"]
    assert errors(["A" * 7]) == ["too short"] and errors(["A" * 51]) == ["too long"] and errors(["A" * 7 + "X"]) == ["illegal letter"]
    assert errors([""]) == ["empty sequence"] and errors(["A" * 8], header=" ") == ["blank header"]
    top = lambda seqs: spark.createDataFrame([(k, s) for k, s in enumerate(seqs)], "record long, seq string")
    library = frame(spark, ["A" * 8, "C" * 8])
    assert validate.ranked_list_errors(top(["A" * 8, "C" * 8]), library, 2).count() == 0
    assert {r["error"] for r in validate.ranked_list_errors(top(["D" * 8, "A" * 8, "A" * 8]), library, 2).collect()} == {"not in library", "duplicate", "count 3"}
    with pytest.raises(ValueError, match="errors"):
        validate.require_none(validate.ranked_list_errors(top(["D" * 8]), library, 1))
    assert validate.same_rows(library, library.orderBy("seq")) and validate.content_hash(library) == validate.content_hash(library.repartition(3))
    assert validate.too_similar(frame(spark, ["A" * 10]), frame(spark, ["A" * 8 + "CC"])).count() == 0
    assert validate.too_similar(frame(spark, ["A" * 10]), frame(spark, ["A" * 9 + "C"])).count() == 1


def test_alignment(spark):
    rule = align.match_score()
    assert align.local_alignment("ACDEFG", "ACDEFG", rule) == (30, 6, 6, 1, 6, 1, 6)
    assert align.local_alignment("WWWACDEFG", "ACDEFGYY", rule)[:5] == (30, 6, 6, 4, 9)
    assert align.local_alignment("AAAA", "CCCC", rule)[0] == 0
    gap = align.local_alignment("ACDEFGHIKL", "ACDEFWGHIKL", rule)
    assert gap[0] == 10 * 5 - 11 and gap[2] == 11
    rows = align.with_bits(align.align_all(frame(spark, ["ACDEFGHI"]), frame(spark, ["ACDEFGHI", "WWWWWWWW", "CDEFGHIK"]))).collect()
    assert {r["target"] for r in rows} == {"ACDEFGHI", "CDEFGHIK"} and all(r["bits"] > 0 for r in rows)


def test_learning_contracts(spark):
    with pytest.raises(Exception, match="left scores out"):
        learn.score_with(frame(spark, ["AAAA"]), lambda s: {"p": np.full(len(s), np.nan)}, ["p"]).collect()
    assert learn.score_with(frame(spark, ["AAAA", "CC"]), lambda s: {"p": np.array([len(x) for x in s], float)}, ["p"]).agg(F.sum("p")).first()[0] == 6
    df = spark.createDataFrame([(k, [float(k % 2), float(k), 1.0], k % 2) for k in range(80)], "id long, features array<double>, label int")
    _, areas = learn.proxy_classifier(df, trees=10)
    assert areas["auroc"] > 0.9
    assert learn.proxy_classifier(df.where("label = 1")) is None


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_batches(spark, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        out = ranking.batches(spark.range(1050).withColumnRenamed("id", "k"), "k", 100).collect()
        assert all(r["batch"] == r["k"] // 100 for r in out) and len(out) == 1050
        ties = spark.range(90).select(F.when(F.col("id") >= 5, F.lit(7)).alias("k"), "id")
        rows = ranking.batches(ties, "k", 10).collect()
        assert sorted(r["batch"] for r in rows) == [k // 10 for k in range(90)] and all(r["batch"] == 0 for r in rows if r["k"] is None)
        draws = ranking.hash_sample_with_replacement(spark.range(20).withColumnRenamed("id", "k"), "k", 50)
        assert sorted(r["draw"] for r in draws.collect()) == list(range(50))
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def greedy_split(rows, shares, seed=42):
    """Family by family, from the largest, to the split that it fits best: what the blocks must add up to."""
    labels = sorted({x for _, _, x in rows})
    made = {}
    for _, f, x in rows:
        made.setdefault(f, [0] * len(labels))[labels.index(x)] += 1
    target = np.outer(list(shares.values()), np.sum(list(made.values()), axis=0))
    held = np.zeros_like(target)
    kind = lambda v: str([{"label": x, "n": n} for x, n in zip(labels, v) if n])
    for v in sorted(made.values(), key=lambda v: (-sum(v), kind(v))):
        cost = (((held + v - target) ** 2 - (held - target) ** 2) / np.maximum(target, 1)).sum(axis=1)
        held[int(cost.argmin())] += v
    return (((held - target) ** 2) / np.maximum(target, 1)).sum()


def test_split_of_many_equal_families(spark):
    rows = [(f"s{k}", f"f{k}", 0) for k in range(3000)] + [(f"t{k}", "large", 1) for k in range(50)]
    shares = {"train": 0.8, "dev": 0.1, "audit": 0.1}
    out = allocation.split_families(spark.createDataFrame(rows, "seq string, family string, label int"), shares).collect()
    assert len(out) == len(rows) == len({r["seq"] for r in out})
    n = {s: sum(r["split"] == s and r["seq"][0] == "s" for r in out) for s in shares}
    assert max(abs(n[s] - 3000 * shares[s]) for s in shares) <= 1
    rng = np.random.default_rng(7)
    rows = [(f"s{k}", f"f{rng.integers(0, 90)}", int(rng.random() < 0.3)) for k in range(400)]
    out = {r["seq"]: r["split"] for r in allocation.split_families(spark.createDataFrame(rows, "seq string, family string, label int"), shares).collect()}
    total = [sum(x == k for _, _, x in rows) for k in (0, 1)]
    cost = sum((sum(out[s] == name and x == k for s, _, x in rows) - share * total[k]) ** 2 / max(share * total[k], 1) for name, share in shares.items() for k in (0, 1))
    assert cost <= greedy_split(rows, shares) + 0.5


def test_votes_demand_every_cell(spark):
    rows = [("a", "m", "f", "p", 1.0), ("b", "m", "f", "p", 2.0), ("a", "n", "g", "p", 1.0), ("b", "n", "g", "p", 3.0)]
    table = lambda r: spark.createDataFrame(r, "seq string, model string, family string, kind string, value double")
    assert {r["seq"]: r["vote"] for r in ranking.model_votes(table(rows)).collect()} == {"a": 0.25, "b": 0.75}
    with pytest.raises(Exception, match="missing for a"):
        ranking.model_votes(table(rows[1:])).collect()
    with pytest.raises(Exception, match="nonfinite"):
        ranking.model_votes(table([*rows[:3], ("b", "n", "g", "p", None)])).collect()


def test_winner_of_ties(spark):
    rows = spark.createDataFrame([("b", 3, 1), ("a", 3, 1), ("c", 2, 9)], "k string, x int, y int").repartition(3)
    assert tuple(selection.winner(rows, "k", [F.col("x"), F.col("y")]).first()) == ("a", 3, 1)


def test_neighbors_of_many_chunks(spark):
    seqs = random_seqs(70)
    r = ratios(seqs, seqs)
    got = {x["seq"]: x for x in similarity.neighbor_bests(frame(spark, seqs), chunk=9).collect()}
    for s in seqs:
        others = [r[s, t] for t in seqs if t != s]
        assert got[s]["neighbors"] == sum(v > 0.8 + 1e-12 for v in others) and 2 * got[s]["best_lcs"] / got[s]["best_total"] == pytest.approx(max(others))
    edges = {(x["a"], x["b"]) for x in similarity.similarity_edges(frame(spark, seqs), chunk=9).collect()}
    assert edges == {(a, b) for (a, b), v in r.items() if a < b and v >= 0.8 - 1e-12}
    best = {x["seq"]: x["best"] for x in similarity.max_similarity(frame(spark, seqs), frame(spark, seqs[::2])).collect()}
    assert best == {s: min(seqs[::2], key=lambda t: (-round(r[s, t], 12), t)) for s in seqs}


def test_random_mmd_reads_every_row(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 4))
    y = np.concatenate([rng.normal(size=(600, 4)), rng.normal(size=(500, 4)) + 2])
    rows = [(k, (x[k // 2] if k % 2 == 0 else y[k // 2]).tolist(), k % 2) for k in range(3000) if k % 2 == 0 or k // 2 < len(y)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.QUERIES["mmd_random"](spark, str(tmp_path)).first()["mmd2"]
    assert got == pytest.approx(vectors.mmd_random_features(x, y), rel=1e-9)
    empty = spark.createDataFrame([], "id long, embedding array<double>")
    assert distributions.mmd_random(empty, empty) is None


def test_conformity_reads_every_row(spark):
    rng = np.random.default_rng(4)
    ref = np.round(np.concatenate([rng.normal(size=(900, 2)), rng.normal(size=(300, 2)) * 3 + 4]), 1)
    new = np.concatenate([np.round(rng.normal(size=(200, 2)) * 2, 1), [[500.0, 0.0]]])
    table = lambda x: spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id long, a double, b double")
    got = {r["id"]: r["conformity"] for r in learn.conformity_scores(table(new), table(ref), ["a", "b"], chunk=300).collect()}
    assert np.allclose([got[k] for k in range(len(new))], vectors.conformity(new, ref), atol=1e-9)
    assert got[200] == 0 and learn.conformity_scores(table(new), table(ref[:0]), ["a", "b"]).where("conformity IS NULL").count() == len(new)


def test_conformity_query_reads_every_sequence(spark, tmp_path):
    seqs = random_seqs(700)
    spark.createDataFrame(list(enumerate(seqs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["seq"]: r["conformity"] for r in catalogue.QUERIES["conformity_scores"](spark, str(tmp_path)).collect()}
    props = frame(spark, seqs).select("seq", *(c.alias(k) for k, c in residues.properties(F.col("seq")).items())).toPandas()
    x = props[["length", "charge", "hydrophobicity", "moment"]].to_numpy(float)
    assert len(got) == len(seqs) > 512
    assert np.allclose([got[s] for s in props["seq"]], vectors.conformity(x, x), atol=1.5 / len(seqs))


def test_alignments_of_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(6)
    draw = lambda n, low, high: sorted({"".join(rng.choice(list("ACDE"), rng.integers(low, high))) for _ in range(n)})
    queries, refs = draw(25, 8, 30), [*draw(20, 1, 40), "ACDE" * 20, "W"]
    spark.createDataFrame(list(enumerate(queries)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0, s) for k, s in enumerate(refs)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [tuple(r) for r in catalogue.QUERIES["local_alignments"](spark, str(tmp_path)).collect()]
    each = {(q, t): align.local_alignment(q, t, align.match_score()) for q in queries for t in refs}
    assert sorted(r[:-1] for r in rows) == sorted((q, t, *r, len(q), len(t)) for (q, t), r in each.items() if r[0])
    for q, t, raw, nident, alnlen, qs, qe, ts, te, _, _, cigar in rows:
        assert replay(cigar, q[qs - 1 : qe], t[ts - 1 : te]) == (raw, nident, alnlen)
    mers = lambda s, k: {s[i : i + k] for i in range(len(s) - k + 1)}
    some = [tuple(r) for r in align.align_seeded(frame(spark, queries), frame(spark, refs), k=5).collect()]
    assert sorted(some) == sorted(r for r in rows if mers(r[0], 5) & mers(r[1], 5))
    hits = {(r["query"], r["target"]): r["hits"] for r in align.seed_pairs(frame(spark, queries), frame(spark, refs), k=4, band=8, least_hits=2).collect()}
    expected = {}
    for q in queries:
        for t in refs:
            bands = collections.Counter((i - j) // 8 for i in range(len(q) - 3) for j in range(len(t) - 3) if q[i : i + 4] == t[j : j + 4])
            if bands and max(bands.values()) >= 2:
                expected[q, t] = max(bands.values())
    assert hits == expected


def replay(cigar, q, t, gap_open=11, gap_extend=1):
    """Score, identities and columns of an alignment that uses up both strings."""
    i = j = raw = same = columns = 0
    for n, op in re.findall(r"(\d+)([MID])", cigar):
        n = int(n)
        columns += n
        if op == "M":
            raw += sum(align.match_score()(x, y) for x, y in zip(q[i : i + n], t[j : j + n]))
            same += sum(x == y for x, y in zip(q[i : i + n], t[j : j + n]))
        else:
            raw -= gap_open + gap_extend * (n - 1)
        i, j = i + n * (op != "D"), j + n * (op != "I")
    assert (i, j) == (len(q), len(t))
    return raw, same, columns


@pytest.mark.parametrize("directions", [1 << 25, 900])
def test_tracebacks_of_long_and_gapped_pairs(monkeypatch, directions):
    """Saved rows give the same columns as one table; long pairs take the same path as packed ones."""
    monkeypatch.setattr(align, "DIRECTIONS", directions)
    rng = np.random.default_rng(13)
    base = "".join(rng.choice(list("ACDEFGH"), 120))
    change = lambda s: "".join(c if rng.random() < 0.93 else rng.choice(["", "W", c + "KLMNPQ"]) for c in s)
    q, t = lcs.Strings([change(base[k : k + 50 + k]) for k in range(0, 60, 6)] + ["ACD"]), lcs.Strings([change(base) for _ in range(10)] + ["WWACDWW"])
    p, r = np.divmod(np.arange(len(q) * len(t)), len(t))
    rows = [x for b in align.alignment_rows(q, t, p, r, align.match_score(3, -1)) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert any("I" in x[-1] for x in rows) and any("D" in x[-1] for x in rows)
    for x in rows:
        one = align.local_alignment(x[0], x[1], align.match_score(3, -1))
        assert tuple(x[2:9]) == one
        n = sum(int(k) for k in re.findall(r"\d+", x[-1]))
        assert n == one[2]
    monkeypatch.setattr(align, "local_alignments", None)
    far = [x for b in align.alignment_rows(lcs.Strings(["ACDEFG"]), lcs.Strings(["W" * (1 << 15) + "ACDFG"]), np.zeros(1, np.int64), np.zeros(1, np.int64), align.match_score(5, -4)) for x in zip(*(c.to_pylist() for c in b.columns))]
    assert far[0][2:5] == (15, 3, 3) and far[0][-1] == "3M"


@pytest.mark.parametrize("row", [1 << 15, 300])
def test_swept_alignments_match_those_of_pairs(monkeypatch, row):
    """Each query meets blocks of targets at once, and no list of pairs; pairs beyond the blocks' numbers go the former way."""
    monkeypatch.setattr(align, "ROW", row)
    rng = np.random.default_rng(14)
    base = "".join(rng.choice(list("ACDEFGH"), 120))
    change = lambda s: "".join(c if rng.random() < 0.9 else rng.choice(["", "W", c + "KLMNPQ"]) for c in s)
    draw = lambda n, high: {"".join(rng.choice(list("ACD"), rng.integers(1, high))) for _ in range(n)}
    q, t = lcs.Strings(sorted(draw(30, 40) | {change(base[k : k + 50]) for k in range(0, 60, 6)})), lcs.Strings(sorted(draw(30, 60) | {"W", *(change(base) for _ in range(10))}))
    rows = lambda batches: sorted(x for b in batches for x in zip(*(c.to_pylist() for c in b.columns)))
    p, r = np.divmod(np.arange(len(q) * len(t)), len(t))
    expected = rows(align.alignment_rows(q, t, p, r, align.match_score()))
    assert any("I" in x[-1] for x in expected) and any("D" in x[-1] for x in expected)
    with monkeypatch.context() as m:
        m.setattr(align, "alignment_rows", None)
        assert rows(align.all_rows(q, t, align.match_score())) == expected
    monkeypatch.setattr(align, "TABLE", 1500)
    assert rows(align.all_rows(q, t, align.match_score())) == expected


@pytest.mark.parametrize("rule", [align.match_score(), align.match_score(2, -9), lambda a, b: 6 - abs(ord(a) - ord(b)) * 3])
def test_few_pairs_need_a_table_with_gaps(monkeypatch, rule):
    """Pairs are aligned without gaps first; only those that may do better with gaps get such a table, and no result differs."""
    rng = np.random.default_rng(15)
    draw = lambda n, low, high: sorted({"".join(rng.choice(list("ACDEFGHIKLMN"), rng.integers(low, high))) for _ in range(n)})
    q, t = draw(60, 8, 40), draw(60, 1, 40)
    t = sorted({*t, *(x[:12] + "WW" + x[12:] for x in q[:10]), *(x[:8] + x[10:] + "Y" for x in q[10:20]), *(x[:9] + "W" + x[9:16] + "WYW" + x[16:] for x in q[20:40])})
    seen, table = [], align._table
    monkeypatch.setattr(align, "_table", lambda qs, ts, *x: seen.append(qs.shape[1]) or table(qs, ts, *x))
    monkeypatch.setattr(align, "local_alignments", None)
    monkeypatch.setattr(align, "HELD", 100)
    rows = [x for b in align.all_rows(lcs.Strings(q), lcs.Strings(t), rule) for x in zip(*(c.to_pylist() for c in b.columns))]
    each = {(a, b): align.local_alignment(a, b, rule) for a in q for b in t}
    assert sorted(x[:-1] for x in rows) == sorted((a, b, *x, len(a), len(b)) for (a, b), x in each.items() if x[0])
    assert any("I" in x[-1] for x in rows) and any("D" in x[-1] for x in rows)
    assert all(sum(int(n) for n in re.findall(r"\d+", x[-1])) == x[4] for x in rows)
    if rule("A", "A") == 5:
        assert sum(seen) < 0.5 * len(each)


def test_pairs_are_not_padded_to_the_longest(monkeypatch):
    """A few long targets make no large tables of all other pairs."""
    rng = np.random.default_rng(17)
    draw = lambda n: "".join(rng.choice(list("ACDEFGH"), n))
    q, t = lcs.Strings([draw(n) for n in rng.integers(8, 40, 40)]), lcs.Strings([draw(n) for n in [*rng.integers(8, 60, 39), 900]])
    p, r = np.divmod(np.arange(1600), 40)
    cells, table = [], align._table
    monkeypatch.setattr(align, "_table", lambda qs, ts, *x: cells.append(qs.size * len(ts)) or table(qs, ts, *x))
    rows = {x[:2]: x[2:9] for b in align.alignment_rows(q, t, p, r, align.match_score()) for x in zip(*(c.to_pylist() for c in b.columns))}
    assert sum(cells) < 2.5 * (q.size[p] * t.size[r]).sum()
    for k in rng.permutation(1600)[:60].tolist():
        a, b = q.strings[p[k]], t.strings[r[k]]
        assert rows.get((a, b), (0,) * 7) == align.local_alignment(a, b, align.match_score())


def test_chunks_of_long_strings_have_no_more_letters(spark, monkeypatch):
    """Where work goes with letters, the longest strings are no chunk of as many strings: it would be one task with most of the work."""
    monkeypatch.setattr(similarity, "LEAST_CHUNK", 1)
    rng = np.random.default_rng(16)
    refs = sorted({"".join(rng.choice(list("ACDE"), n)) for n in [*rng.integers(8, 20, 300), *[900] * 40]})
    rows, _ = similarity._chunked(frame(spark, refs), "seq", 40, 8, even=True)
    letters = [r["n"] for r in rows.groupBy("band", "at").agg(F.sum(F.length("seq")).alias("n")).collect()]
    assert sum(letters) == sum(map(len, refs)) and max(letters) < 0.25 * sum(letters)


def test_feature_queries_give_values(spark, tmp_path):
    x = np.random.default_rng(8).normal(size=(60, 5))
    spark.createDataFrame([(k, v.tolist(), k % 2) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["id"]: [float(v) for v in r["rff"].split(",")] for r in catalogue.QUERIES["random_fourier_features"](spark, str(tmp_path)).collect()}
    b = x[1::2]
    gaps = ((b[:, None] - b[None]) ** 2).sum(axis=2)
    assert sorted(got) == list(range(0, 60, 2))
    phi = np.array([got[k] for k in sorted(got)])
    kernel = np.exp(-((x[::2][:, None] - x[::2][None]) ** 2).sum(axis=2) / (2 * np.median(gaps[gaps > 1e-12])))
    assert phi.shape == (30, 128) and np.abs(phi @ phi.T - kernel).mean() < 0.1
    moments = {r["vec_id"]: [float(v) for v in r["moments"].split(",")] for r in catalogue.QUERIES["embedding_moments"](spark, str(tmp_path)).collect()}
    z = x - x.mean(axis=0)
    pc = z @ np.linalg.svd(z)[2][:4].T
    pc /= np.sqrt((pc**2).sum(axis=1).mean())
    pairs = np.column_stack([*pc.T, *(pc[:, i] * pc[:, j] for i in range(4) for j in range(i + 1))])
    # A component's sign is arbitrary.
    assert np.allclose(np.sort(np.abs([moments[k] for k in range(60)]), axis=1), np.sort(np.abs(pairs), axis=1), atol=2e-6)


def test_proxy_is_scored_on_held_out_rows(spark, tmp_path):
    x = np.random.default_rng(9).normal(size=(300, 4))
    rows = [(k, v.tolist(), int(k % 3 == 0)) for k, v in enumerate(x)]  # labels without any signal
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["metric"]: r["value"] for r in catalogue.QUERIES["proxy_classifier"](spark, str(tmp_path)).collect()}
    assert 0.3 < got["auroc"] < 0.7
    vectors_ = spark.createDataFrame([(k, v) for k, v, _ in rows], "id long, embedding array<double>")
    floor = reports.reference_floor(vectors_, (1,))
    p, r = distributions.precision_recall(*ranking.hash_halves(vectors_, "id", 1))
    assert floor["precision"] == (p, 0.0) and floor["recall"] == (r, 0.0)


def test_conditional_draws_do_not_depend_on_partitions(spark):
    """Conditions drawn with replacement, shrunk, and sampled: the same pool however the rows are dealt, without known sequences."""
    seqs = random_seqs(40, letters="ACDEFGHIKL")
    props = frame(spark, seqs).select("seq", *(c.alias(k) for k, c in residues.properties(F.col("seq")).items()))
    calls = spark.sparkContext.accumulator(0)

    def sampler(conditions, seed):
        calls.add(1)
        rng = np.random.default_rng(seed)
        return ["".join(rng.choice(list("ACDEFGHIKL"), int(n))) for n in conditions[:, 0]]

    made = []
    for parts in (1, 5):
        drawn = ranking.hash_sample_with_replacement(props.repartition(parts), "seq", 95)
        assert drawn.count() == 95 and drawn.select("seq").distinct().count() < 40
        made.append(sorted(tuple(r) for r in learn.generate_with(drawn.repartition(parts), sampler, ["length", "charge"], batch=20).collect()))
    assert made[0] == made[1] and [d for d, _ in made[0]] == list(range(95)) and calls.value == 10
    pool = sets.exclude(spark.createDataFrame(made[0], "draw long, seq string"), frame(spark, [made[0][0][1]]))
    assert made[0][0][1] not in {r["seq"] for r in pool.collect()}
    with pytest.raises(Exception, match="left draws out"):
        learn.generate_with(drawn, lambda c, s: ["A"], ["length"]).collect()


def test_set_gates(spark):
    a, b = frame(spark, ["A", "B", "B"]), frame(spark, ["B", "A", "C"])
    assert sets.is_subset(a, b) and not sets.is_subset(b, a) and sets.is_subset(a.limit(0), a)
    assert sets.equal_sets(a, frame(spark, ["A", "B"])) and not sets.equal_sets(a, b)


def test_first_occurrences_and_string_numbers(spark):
    df = spark.createDataFrame([(5, "b"), (1, "c"), (2, "b"), (9, "a"), (3, "c")], "at long, seq string")
    assert [tuple(r) for r in ranking.first_occurrences(df, "seq", "at").collect()] == [("c", 1), ("b", 2), ("a", 9)]
    words = [f"prefix{k % 700:04d}é{k}" for k in range(1500)] + ["", "z", "prefix"]
    got = {r["seq"]: r["n"] for r in ranking.numbered(frame(spark, words).repartition(6), "seq", "n").collect()}
    assert got == {w: k for k, w in enumerate(sorted(words, key=lambda w: w.encode()))}


def test_principal_components_and_property_regions(spark):
    x = np.random.default_rng(15).normal(size=(200, 4)) * [5, 3, 1, 0.1]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>")
    (out,) = learn.principal_components(df, [df], k=2)
    got = np.array([r["pc"] for r in out.orderBy("id").collect()])
    z = x - x.mean(axis=0)
    want = z @ np.linalg.svd(z)[2][:2].T
    want /= np.sqrt((want**2).sum(axis=1).mean())
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-9)
    props = lambda s: frame(spark, s).select("seq", *(c.alias(k) for k, c in residues.properties(F.col("seq")).items()))
    ref, rows = props(random_seqs(300, 1)), props(random_seqs(50, 2) + ["K" * 50])
    scaled_ref = learn.scaled_properties(ref, ref)
    values = np.array([r["pc"] for r in scaled_ref.collect()])
    assert np.allclose(values.mean(axis=0), 0, atol=1e-9) and np.allclose(values.std(axis=0), 1)
    (placed,), weights = learn.regions(scaled_ref, [learn.scaled_properties(rows, ref)], most=5)
    assert placed.count() == rows.count() and weights.agg(F.sum("weight")).first()[0] == pytest.approx(1)
    assert {r["region"] for r in placed.collect()} <= {r["region"] for r in weights.collect()}


@pytest.mark.parametrize("own", [False, True])
def test_swept_bests_and_pairs_match_all_pairs(own):
    """Words of all kinds, strings beyond a word, common beginnings, letters that the other side lacks."""
    rng = np.random.default_rng(21)
    draw = lambda n, letters: {"".join(rng.choice(list(letters), rng.integers(1, 80))) for _ in range(n)}
    a = sorted(draw(60, "ACDEF") | {"A" * k for k in (1, 8, 16, 17, 32, 33, 64, 65, 90)})
    b = a if own else sorted(draw(80, "ACDK") | {"A" * 16 + "K", "A" * 64, "A" * 70})
    r, x, y = ratios(a, b), lcs.Strings(a), lcs.Strings(b)
    best, n, total, near = lcs.best_of(x, y, 60, own)
    for k, s in enumerate(a):
        others = [t for t in b if not own or s != t]
        assert b[best[k]] == min(others, key=lambda t: (-round(r[s, t], 12), t)) and 2 * n[k] / total[k] == pytest.approx(r[s, b[best[k]]])
        assert near[k] == sum(r[s, t] > 0.6 + 1e-12 for t in others)
    i, j, n = lcs.near_pairs(x, None if own else y, 60)
    found = [tuple(sorted((a[p], b[q]))) if own else (a[p], b[q]) for p, q in zip(i, j)]
    assert len(found) == len(set(found)) and set(found) == {p for p, v in r.items() if v >= 0.6 - 1e-12 and (not own or p[0] < p[1])}
    assert all(2 * k / (len(a[p]) + len(b[q])) == pytest.approx(r[a[p], b[q]]) for p, q, k in zip(i, j, n))


def test_units_of_work_are_tasks(spark):
    """Few bytes may be much work: the engine must not put all units of a fuzzy join in one task."""
    plan = similarity.max_similarity(frame(spark, random_seqs(400)), frame(spark, random_seqs(30, 1)), chunk=300)
    assert plan.rdd.getNumPartitions() > 1


def test_distances_by_products_are_settled_from_differences(spark):
    """Far from the origin a matrix product rounds away small distances: copies, and balls that a point just touches, must still count."""
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat(rng.normal(size=(4, 8)), 12, axis=0), rng.normal(size=(60, 8)) * 1e-3]) + 1e4
    y = np.concatenate([x[::3], rng.normal(size=(30, 8)) * 2e-3 + 1e4])
    d = lambda p, q: ((p[:, None] - q[None]) ** 2).sum(axis=2)
    table = lambda v, at: spark.createDataFrame([(at + k, r.tolist()) for k, r in enumerate(v)], "id long, embedding array<double>")
    expected = np.sort(d(x, x), axis=1)[:, 3]
    got = {r["id"]: r["radius2"] for r in distributions.knn_radius(table(x, 0), 3, 16).collect()}
    assert [got[k] for k in range(len(x))] == pytest.approx(expected.tolist(), rel=1e-12, abs=0)
    assert distributions.covered(table(y, 1000), table(x, 0), 3, 16) == pytest.approx((d(y, x) <= expected[None]).any(axis=1).mean())
    rows, units = distributions._vector_blocks(table(x, 0), table(y, 1000), 16)
    assert rows.select("unit").distinct().count() <= units
    near = lambda p, q: np.exp(-d(p, q) / 2)
    assert distributions.kernel_sums(table(x - 1e4, 0), table(x - 1e4, 0), 1.0, 16) == pytest.approx(near(x - 1e4, x - 1e4).sum() - len(x))


@pytest.mark.parametrize("most", [1 << 21, 5])
def test_seed_hits_are_counted_in_units(spark, monkeypatch, most):
    """Only strings are shuffled: the plan has no join of k-mers, and pairs of many units and small slices are those of a count of all places."""
    monkeypatch.setattr(align, "HITS", most)
    rng = np.random.default_rng(31)
    draw = lambda n, m: sorted({"".join(rng.choice(list("ACD"), rng.integers(1, m))) for _ in range(n)})
    a, b = draw(40, 30), [*draw(30, 60), "AC" * 50]
    out = align.seed_pairs(frame(spark, a), frame(spark, b), k=4, band=5, least_hits=2, chunk=11)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    expected = {}
    for q in a:
        for t in b:
            bands = [(i - j) // 5 for i in range(len(q) - 3) for j in range(len(t) - 3) if q[i : i + 4] == t[j : j + 4]]
            if bands and (n := max(bands.count(x) for x in set(bands))) >= 2:
                expected[q, t] = n
    assert {(r["query"], r["target"]): r["hits"] for r in out.collect()} == expected
    slices = list(align._hits(lcs.Strings(a), lcs.Strings(b), 4, 5))
    assert {(a[q], b[t]): n for x in slices for q, t, n in zip(*x) if n >= 2} == expected and (len(slices) > 1) == (most == 5)


def test_records_are_made_once(spark):
    """What the checks read several times is a table in the shared folder: an expensive column is computed once a row, and errors stay the same."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def letters(text):
        made.add(1)
        return text

    rows = spark.createDataFrame([(k, str(k), s) for k, s in enumerate(["ACDEFGHIK", "ACDEFGHIK", "A", "", "Z" * 9])], "record long, header string, text string")
    records = rows.select("record", "header", letters("text").alias("seq"))
    got = {(r["record"], r["error"]) for r in validate.library_errors(records).collect()}
    assert got == {(0, "duplicate"), (1, "duplicate"), (2, "too short"), (3, "empty sequence"), (4, "illegal letter")}
    assert made.value == rows.count()


def test_region_properties_are_made_once(spark, monkeypatch, tmp_path):
    """Texts are read into the properties of both tables once, whatever reads these."""
    made, write = [], catalogue.tables.materialize
    monkeypatch.setattr(catalogue.tables, "materialize", lambda df, name: made.append(name) or write(df, name))
    rng = np.random.default_rng(47)
    texts = ["".join(rng.choice(list("ACDEFGHIKL"), rng.integers(8, 30))) for _ in range(120)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0, t[::-1]) for k, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = catalogue.QUERIES["property_regions"](spark, str(tmp_path)).collect()
    assert made == ["properties", "properties"] and sorted(r["seq"] for r in rows) == sorted(set(texts))


def test_bests_are_swept_in_whole_chunks(spark, monkeypatch):
    """A step over a few strings costs as much as one over thousands: the left side is not cut to make tasks, the reference is."""
    real = similarity._chunked
    sizes = []
    monkeypatch.setattr(similarity, "_chunked", lambda *a: sizes.append(real(*a)) or sizes[-1])
    monkeypatch.setattr(similarity, "SMALL_LETTERS", 1)
    left, ref = random_seqs(2000), random_seqs(900, 1)
    got = {r["seq"]: (r["best_lcs"], r["best_total"], r["best"]) for r in similarity.max_similarity(frame(spark, left), frame(spark, ref)).collect()}
    assert [sum(x[2] for x in s) for _, s in sizes] == [1, 4]  # all of the left side, and references of LEAST_CHUNK strings
    at, n, total, _ = lcs.best_of(lcs.Strings(left), lcs.Strings(sorted(ref)))
    assert got == {s: (n[k], total[k], sorted(ref)[at[k]]) for k, s in enumerate(left)}


def test_texts_of_a_selection_are_read_once(spark, monkeypatch):
    """The known sequences and the labelled ones are each made once, and properties are not computed behind a limit."""
    plans = []
    real = tables.materialize

    def materialize(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return real(df, name)

    for module in (catalogue.tables, catalogue.selection, catalogue.similarity):
        monkeypatch.setattr(module, "materialize", materialize)
    c, rp, *_ = catalogue._selection(spark, "/root/testdata/sf0.001")
    assert [name for name, plan in plans if "regexp_replace" in plan] == ["known", "labelled"]
    assert not any("Limit" in plan for _, plan in plans)
    assert c.seq == sorted(c.seq) and c.props.shape == c.embedding.shape == (len(c.seq), 4) and len(rp)
    assert [tuple(r) for r in spark.createDataFrame([(x,) for x in c.seq], "seq string").select(*residues.properties(F.col("seq")).values()).collect()] == [tuple(r) for r in c.props.tolist()]
    with pytest.raises(ValueError, match="too many"):
        catalogue.selection.gathered(spark.range(3), "id", 2, "too many")


def test_numbers_take_one_shuffle(spark):
    """Rows are numbered where a shuffle by ranges puts them: no join of the rows with their keys, and no window over rows or keys."""
    rows = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("k"), F.lit("x").alias("_at")).repartition(7)
    plan = ranking.numbered(rows, "k", "n")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text
    assert [(r["n"], r["_at"]) for r in plan.orderBy("k").collect()] == [(k, "x") for k in range(3000)]
    hot = spark.createDataFrame([(None if k % 3 == 0 else 5 if k % 3 == 1 else k, k) for k in range(3000)], "k int, v int")
    got = ranking.numbered(hot, "k", "_at").toPandas().sort_values("_at")
    assert got["_at"].tolist() == list(range(3000)) and got["k"].isna().tolist() == [True] * 1000 + [False] * 2000
    assert got["k"].dropna().is_monotonic_increasing and sorted(got["v"]) == list(range(3000))
    assert ranking.numbered(hot.limit(0), "k", "n").count() == 0


@pytest.mark.parametrize("d", [1, 2, 4])
def test_conformity_on_a_lattice(spark, monkeypatch, d):
    """Many vectors are summed over tiles of a lattice, whose rows grow with the vectors; the densities are those of all pairs."""
    rng = np.random.default_rng(d)
    ref = np.concatenate([rng.normal(size=(400, d)), rng.normal(size=(60, d)) * 4 + 3, np.full((20, d), 0.5)])
    new = np.concatenate([rng.normal(size=(90, d)) * 2, np.full((1, d), 1e7)])
    keys = [f"c{k}" for k in range(d)]
    table = lambda x: spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "id long, " + ", ".join(f"{k} double" for k in keys))
    used, real = [], learn._lattice_densities
    monkeypatch.setattr(learn, "LATTICE_ROWS", 1)
    monkeypatch.setattr(learn, "_lattice_densities", lambda *a: used.append(real(*a)) or used[-1])
    got = {r["id"]: r["conformity"] for r in learn.conformity_scores(table(new), table(ref), keys).collect()}
    assert len(used) == 1 and [got[k] for k in range(len(new))] == vectors.conformity(new, ref).tolist() and got[90] == 0
    width = np.maximum(ref.std(axis=0), 1e-12) * (len(ref) * (d + 2) / 4) ** (-1 / (d + 4)) * np.sqrt(2)
    dense = {tuple(r[k] for k in range(d)): r["density"] for r in used[0].toDF(*keys, "density").collect()}
    x = np.array(list(dense))
    exact = np.exp(-(((x[:, None] - ref[None]) / width) ** 2).sum(axis=2)).sum(axis=1)
    assert np.allclose(list(dense.values()), exact, rtol=1e-12, atol=1e-15)
