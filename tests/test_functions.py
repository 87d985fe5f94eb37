import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import lcs, residues, vectors
from seqloom.operators import selection
from seqloom.operators.allocation import water_fill

# seq -> length, charge, hydrophobicity, moment
GOLDEN = {
    "AAAALFNRSFTQALGK": (16, 1.908897, 0.136875, 0.338925),
    "AAAYFNEYRRIPRYGSDACF": (20, 0.861151, -0.114, 0.433503),
    "AAGAGKVTKSAQKAQKAK": (18, 4.907636, -0.203889, 0.271717),
    "AAAAAAAA": (8, -0.090783, 0.62, 0.06503),
    "ACDEFGHIKLMNPQRSTVWY": (20, -0.046663, 0.0, 0.057624),
}


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def test_properties(spark):
    df = spark.createDataFrame([(s,) for s in GOLDEN], "seq string")
    rows = df.select("seq", *(c.alias(k) for k, c in residues.properties(F.col("seq")).items())).collect()
    for r in rows:
        assert np.allclose([r["length"], r["charge"], r["hydrophobicity"], r["moment"]], GOLDEN[r["seq"]], atol=2e-6)


def test_scalar_columns(spark):
    df = spark.createDataFrame([("AAACCK",), ("A",)], "seq string")
    s = F.col("seq")
    a, b = df.select(residues.longest_run(s), residues.tokens(s, 8), residues.dipeptides(s), residues.count_in(s, "CMW"), residues.canonical(s), residues.canonical(s, None, None)).collect()
    assert tuple(a) == (3, [0, 0, 0, 1, 1, 8, 20, 20], ["AA", "AA", "AC", "CC", "CK"], 2, False, True)
    assert tuple(b)[0] == 1 and b[2] == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ACDE", max_size=70), min_size=1, max_size=6), st.lists(st.text("ACDEK", max_size=64), min_size=1, max_size=6))
def test_lcs_kernel(a, b):
    got = lcs.lcs_matrix(a, b)
    assert all(got[i, j] == slow_lcs(x, y) for i, x in enumerate(a) for j, y in enumerate(b))
    assert (lcs.lcs_matrix(b, a) == got.T).all()
    assert all(lcs.lcs_long(x, y) == slow_lcs(x, y) for x in a for y in b)


def test_lcs_expression(spark):
    pairs = [("A" * 10, "A" * 8 + "CC"), ("A" * 10, "A" * 9 + "C"), ("ACDEFGHIK", "A" * 10), ("AAAALFNRSFTQALGK", "AAFPIPTSRPRNFGRARLLL"), ("", "A"), ("AC", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(lcs.lcs_column(F.col("a"), F.col("b"))).collect()] == [8, 9, 1, 7, 0, 0]


def test_threshold_border(spark):
    df = spark.createDataFrame([(8, 10, 10), (9, 10, 10)], "n int, la int, lb int")
    n, la, lb = (F.col(c) for c in df.columns)
    assert [tuple(r) for r in df.select(lcs.ratio_at_least(n, la, lb), lcs.ratio_above(n, la, lb)).collect()] == [(True, False), (True, True)]


def test_water_fill():
    assert water_fill(10, [0.5, 0.3, 0.2], [2, 10, 10]).tolist() == [2, 5, 3]
    assert water_fill(7, [0, 0, 1], [3, 3, 2]).tolist() == [3, 2, 2]
    assert water_fill(5, [0.4, 0.4, 0.2], [9, 9, 9]).tolist() == [2, 2, 1]
    with pytest.raises(ValueError):
        water_fill(5, [1, 1], [2, 2])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 20)), min_size=1, max_size=12), st.data())
def test_water_fill_bounds(strata, data):
    cap = [c for _, c in strata]
    if sum(cap):
        n = data.draw(st.integers(1, sum(cap)))
        quota = water_fill(n, [w for w, _ in strata], cap)
        assert quota.sum() == n and (quota <= cap).all() and (quota >= 0).all()


def test_frechet():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, 5)), rng.normal(1, 2, size=(400, 5))
    a, b = vectors.Gaussian.of(x), vectors.Gaussian.of(y)
    assert np.allclose(a.covariance, np.cov(x, rowvar=False))
    assert vectors.frechet(a, a) == pytest.approx(0, abs=1e-8)
    assert vectors.frechet(vectors.Gaussian.of(x[:1]), b) is None
    moved = a.swapped(x[:3], y[:3])
    assert vectors.frechet(moved, b) == pytest.approx(vectors.frechet(vectors.Gaussian.of(np.concatenate([x[3:], y[:3]])), b))
    # adding a vector against the direction lowers the distance
    score = vectors.Slope.between(a, b)(y)
    best = y[score.argmin()][None]
    assert vectors.frechet(a.swapped(x[:0], best), b) < vectors.frechet(a, b)


def pool(n=120, seed=0):
    rng = np.random.default_rng(seed)
    seqs = sorted({"".join(rng.choice(list("ACDEFGHIKL"), rng.integers(8, 20))) for _ in range(n)})
    m = len(seqs)
    props = rng.normal(size=(m, 4))
    return selection.Candidates(seqs, rng.random(m), rng.uniform(1, 40, m), rng.random(m), rng.random(m), rng.integers(0, 3, m), props, rng.normal(size=(m, 6))), rng


def test_swaps_keep_quotas_and_guards():
    c, rng = pool()
    start = selection.quota_start(c, np.array([10, 10, 10]))
    features = rng.normal(size=(len(c.seq), 8))
    chosen, report = selection.coverage_swaps(c, start, features, features.mean(axis=0))
    assert report["after"] <= report["before"] and (np.bincount(c.region[chosen]) == 10).all() and len(set(chosen)) == 30
    guards = selection.Guards([slice(0, 4), slice(4, 8)], features.mean(axis=0))
    chosen, shots, _ = selection.guarded_swaps(c, start, features, guards, rounds=100)
    assert c.mic[chosen].mean() <= c.mic[start].mean() and (np.bincount(c.region[chosen]) == 10).all() and len(shots) == 2
    assert guards.pass_(features[chosen].mean(axis=0), c.prob[chosen].mean(), c.known[chosen].mean())


def test_repairs_remove_edges():
    c, rng = pool()
    c.seq[1] = c.seq[0] + "A"
    start = np.array([0, 1, 5, 6, 7])
    c.mic[:] = 5.0
    c.region[:] = 0
    chosen, report = selection.repair_zero_edge(c, start, np.arange(20, 80))
    assert report["edges_before"] == 1 and report["edges_after"] == 0 == selection.neighbor_numbers([c.seq[i] for i in chosen]).sum()
    features = np.zeros((len(c.seq), 2))
    guards = selection.Guards([slice(0, 2)], np.zeros(2), np.ones(1), 0.0, 1.0)
    _, report = selection.repair_neighbors(c, start, features, guards, 1e9)
    assert report["edges_after"] == 0


def test_cell_allocation():
    c, rng = pool(200)
    hit = c.mic <= 16
    codes = np.column_stack([c.region])
    features = np.array([(c.region == r).astype(float) for r in range(3)])
    ids, report = selection.allocate_cells(c, codes, hit, c.utility, 40, features, np.array([0.5, 0.3, 0.2]), np.ones(3), hit_share=0.6)
    assert len(set(ids)) == 40 and report["hit_constraint"] == (hit.sum() >= 24)
    assert report["hit_fraction"] >= 0.55
    share = np.bincount(c.region[ids], minlength=3) / 40
    assert np.abs(share - [0.5, 0.3, 0.2]).sum() < 0.25


def test_cell_problem_bounds():
    rng = np.random.default_rng(5)
    for hits in (None, 9.0):
        size = rng.integers(1, 9, 12).astype(float)
        table = rng.random((4, 12))
        problem = selection.CellProblem(size, rng.random(12), table, rng.random(4) * 15, np.full(4, 0.7), 20.0, np.arange(12) % 2 == 0, hits)
        x, gap = problem.solve()
        assert gap <= 0.01 * max(1, abs(problem.value(x))) and x.sum() == pytest.approx(20) and (x >= -1e-9).all() and (x <= size + 1e-9).all()
        assert hits is None or x[::2].sum() >= hits - 1e-6
        # no feasible point that a random search finds is better by more than the gap
        for _ in range(300):
            y = problem.project(rng.random(12) * 9)
            assert problem.value(y) <= problem.value(x) + gap + 1e-6
        order = rng.permutation(12)
        whole = selection.whole_counts(x, order)
        assert whole.sum() == 20 and (np.abs(whole - x) < 1 + 1e-6).all() and (whole <= size).all()


def test_exchange_lowers_violation():
    c, rng = pool(150)
    start = np.argsort(c.props[:, 0])[:30]
    reference = vectors.Gaussian.of(c.embedding)
    weights = np.bincount(c.region, minlength=3) / len(c.seq)
    limits = selection.limits_of(selection.selection_metrics(c, np.arange(len(c.seq)), c.props, reference, weights))
    for paired in (False, True):
        chosen, report = selection.exchange(c, start, c.props, reference, weights, limits, 0.0, paired, 3)
        assert selection.violation(report["final"], limits) <= selection.violation(report["initial"], limits)
        assert len(set(chosen.tolist())) == 30


def test_first_feasible():
    k, failed = selection.first_feasible([5, 3, 1], [("big", lambda x: x < 4), ("odd", lambda x: x == 1)])
    assert k == 2 and failed == [["big"], ["odd"], []]


def test_windowed_moment(spark):
    seq = "AAAALFNRSFTQALGK"
    turn = np.deg2rad(100)
    h = lambda s: abs(sum(residues.EISENBERG[a] * np.exp(1j * turn * k) for k, a in enumerate(s))) / len(s)
    expected = np.mean([h(seq[k : k + 11]) for k in range(len(seq) - 10)])
    got = spark.createDataFrame([(seq,), ("AC",)], "seq string").select(residues.windowed_moment(F.col("seq"))).collect()
    assert got[0][0] == pytest.approx(expected) and got[1][0] == pytest.approx(h("AC"))


def test_repair_takes_the_swaps_of_a_full_table():
    """Guards are looked at by falling gain only, and the swaps are those of a table of all admissible ones."""
    rng = np.random.default_rng(8)
    seqs = sorted({"".join(rng.choice(list("AC"), rng.integers(8, 14))) for _ in range(160)})
    n = len(seqs)
    one = lambda: rng.random(n)
    props = rng.normal(size=(n, 4))
    c = selection.Candidates(seqs, one(), one(), one(), one(), rng.integers(0, 2, n), props, props)
    guards = selection.Guards([slice(0, 2), slice(2, 4)], np.zeros(4))
    start = np.arange(0, n, 4)
    guards.caps, guards.prob_floor, guards.known_cap = guards.discrepancy(props[start].mean(axis=0)) * 1.3, c.prob[start].mean() - 0.01, c.known[start].mean() + 0.02
    cap = float(c.mic[start].sum()) * 1.05
    chosen, report = selection.repair_neighbors(c, start, props, guards, cap)

    def full(part, now, gain):
        table = np.zeros(gain.shape, bool)
        for b, s in zip(*np.nonzero(gain)):
            i, o = part[b], now[s]
            new = props[now].mean(axis=0) + (props[i] - props[o]) / len(now), c.prob[now].mean() + (c.prob[i] - c.prob[o]) / len(now), c.known[now].mean() + (c.known[i] - c.known[o]) / len(now)
            table[b, s] = c.region[i] == c.region[o] and c.mic[now].sum() + c.mic[i] - c.mic[o] <= cap and guards.pass_(*new)
        gain = np.where(table, gain, 0)
        return int(gain.argmax()) if gain.any() else None

    expected, _ = selection.remove_edges(c, start, np.lexsort((np.array(c.seq), -c.utility)), full, False, 3000)
    assert report["accepted"] > 3 and chosen.tolist() == expected.tolist()
    count = [sum(200 * lcs.lcs_long(s, t) > 80 * (len(s) + len(t)) for t in seqs) - 1 for s in seqs]
    assert selection.neighbor_numbers(seqs).tolist() == count


@pytest.mark.parametrize("percent", [50, 80, 95])
@pytest.mark.parametrize("measured", [1 << 15, 7])
def test_only_pairs_that_share_letters_are_measured(monkeypatch, percent, measured):
    """The pairs at a threshold are those of all pairs; none is swept over where few share enough letters, also where the bits can't hold all letters."""
    monkeypatch.setattr(lcs, "MEASURED", measured)
    rng = np.random.default_rng(41)
    letters = list("ACDEFGHIKLMNPQRSTVWY")
    draw = lambda n, low, high: ["".join(rng.choice(letters, rng.integers(low, high))) for _ in range(n)]
    first = draw(60, 1, 50) + ["A" * k for k in range(40, 64, 5)] + ["", "W" * 64, "AC" * 32]
    change = lambda s: "".join(c for c in s if rng.random() < 0.9) + str(rng.choice(letters))
    second = sorted({change(s) for s in first} | set(draw(40, 1, 90)) | {"A" * 100, "W" * 70, "AC" * 45})
    first = sorted(set(first))
    for a, b in ((first, second), (second, None)):
        other = a if b is None else b
        expected = set()
        for i, x in enumerate(a):
            for j, y in enumerate(other):
                n = lcs.lcs_long(x, y)
                if (b is not None or i < j) and 200 * n >= percent * (len(x) + len(y)):
                    expected.add((i, j, n))
        with monkeypatch.context() as m:
            if percent > 50:
                m.setattr(lcs, "DENSE", 1.0)
                m.setattr(lcs.Words, "sweep", None)
            i, j, n = lcs.near_pairs(lcs.Strings(a), None if b is None else lcs.Strings(b), percent)
        found = [(min(x, y), max(x, y), z) if b is None else (x, y, z) for x, y, z in zip(i.tolist(), j.tolist(), n.tolist())]
        assert len(found) == len(set(found)) and set(found) == expected


def test_distances_follow_swaps():
    """After one or two swaps the kept distances are those of the columns measured anew, also for repeated values and a value that comes and goes."""
    rng = np.random.default_rng(43)
    props, reference = rng.integers(0, 12, (80, 4)) / 4, rng.integers(0, 15, (50, 4)) / 4
    chosen = rng.permutation(80)[:20]
    spread = selection.Spread(props, reference)
    for step in range(30):
        assert np.allclose(spread.start(chosen), selection.wasserstein_columns(props[chosen], reference)[0], atol=1e-12)
        slots = rng.permutation(20)[: 1 + step % 2]
        into = rng.permutation(np.setdiff1d(np.arange(80), chosen))[: len(slots)]
        new = chosen.copy()
        new[slots] = into
        assert np.allclose(spread.after(chosen[slots], into), selection.wasserstein_columns(props[new], reference)[0], atol=1e-12)
        chosen = new


@pytest.mark.parametrize("least", [None, 3000.0])
def test_projection_of_many_cells(least):
    """Cells that are settled early do not move the shift: the point is feasible and none of a bisection over all cells is nearer."""
    rng = np.random.default_rng(53)
    capacity, x, hit = rng.integers(1, 40, 900).astype(float), rng.normal(5, 30, 900), rng.random(900) < 0.3
    problem = selection.CellProblem(capacity, np.zeros(900), np.zeros((0, 900)), np.zeros(0), np.zeros(0), 5000.0, hit, least)
    y = problem.project(x)

    def onto(v, capacity, total):
        low, high = (v - capacity).min(), v.max()
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if np.clip(v - mid, 0, capacity).sum() > total else (low, mid)
        return np.clip(v - high, 0, capacity)

    z = onto(x, capacity, 5000.0)
    if least is not None and z[hit].sum() < least:
        z[hit], z[~hit] = onto(x[hit], capacity[hit], least), onto(x[~hit], capacity[~hit], 5000.0 - least)
    assert np.allclose(y, z, atol=1e-9) and abs(y.sum() - 5000) < 1e-6


def test_features_are_made_for_the_rows_asked_for(monkeypatch):
    """No table of all features is held, and means are those of the whole table."""
    rng = np.random.default_rng(20)
    props = rng.normal(size=(500, 4))
    fit, cuts = vectors.RandomFeatures.fit(props, 42), [np.quantile(props[:, j], np.linspace(0.005, 0.995, 33)) for j in range(4)]
    features = selection.Features(props, fit, cuts)
    whole = np.column_stack([fit(props), *((props[:, j, None] <= t).astype(float) for j, t in enumerate(cuts))])
    every = features[np.arange(500)]
    assert np.allclose(every, whole, atol=1e-12) and (features[7] == every[7]).all() and (features[np.array([3, 499])] == every[[3, 499]]).all()
    seen, take = [], selection.Features.__getitem__
    monkeypatch.setattr(selection, "HELD", 64)
    monkeypatch.setattr(selection.Features, "__getitem__", lambda self, rows: seen.append(np.size(rows)) or take(self, rows))
    rows = rng.permutation(500)[:301]
    assert (selection.mean_of(features, rows) == every[rows].mean(axis=0)).all() and max(seen) == 64


def test_members_are_swept_and_degrees_come_from_outside(monkeypatch):
    """Nothing lists the pairs of a block with all members, and edges are counted by the function that is given."""
    rng = np.random.default_rng(21)
    draw = lambda n, high: ["".join(rng.choice(list("ACDE"), rng.integers(1, high))) for _ in range(n)]
    seqs, others = draw(60, 30) + draw(4, 120), draw(30, 90) + ["WWWW"]
    members = selection.Members(seqs, block=16)
    for slot in (0, 17, 63):
        seqs[slot] = f"{others[slot % 30]}K"
        members.put(slot, seqs[slot])
    assert (members.near(others) == selection.near_table(others, seqs)).all() and members.near(others).any()
    c, _ = pool(400)
    start, order = np.arange(0, 400, 4)[: len(c.seq) // 4], np.arange(len(c.seq))
    expected, counted = selection.repair_zero_edge(c, start, order), []
    count, shapes, table = selection.neighbor_numbers, [], selection.near_table
    monkeypatch.setattr(selection, "near_table", lambda a, b, *x: shapes.append(len(b)) or table(a, b, *x))
    monkeypatch.setattr(selection, "neighbor_numbers", None)
    got = selection.repair_zero_edge(c, start, order, degrees=lambda s: counted.append(len(s)) or count(s))
    assert got[0].tolist() == expected[0].tolist() and got[1] == expected[1] and counted == [len(start)] and max(shapes, default=1) == 1


@pytest.mark.parametrize("first", [1, 256])
def test_a_pair_is_swept_once_for_both_sides(monkeypatch, first):
    monkeypatch.setattr(lcs, "FIRST", first)
    rng = np.random.default_rng(22)
    draw = lambda n, letters: sorted({"".join(rng.choice(list(letters), rng.integers(1, 60))) for _ in range(n)})
    a, b = lcs.Strings([*draw(90, "ACDE"), "WWW"]), lcs.Strings([*draw(70, "ACDEFG"), "ACAC"])
    swept, sweep = [], lcs.Words.sweep
    monkeypatch.setattr(lcs.Words, "sweep", lambda self, others, limit: swept.append(len(self.start) * len(others)) or sweep(self, others, limit))
    got = lcs.bests_of_both(a, b, 60)
    assert sum(swept) <= len(a) * len(b) + first * len(b)
    for (n, t, near), (x, y) in zip(got, ((a, b), (b, a))):
        at, one, total, many = lcs.best_of(x, y, 60)
        assert (n * total == one * t).all() and near.tolist() == many.tolist() and many.any()
