"""Near-duplicate vectors: subspace pigeonhole join over rotated unit vectors.

Unit vectors are rotated (random signs and Hadamard butterflies: element-wise, so each row's result depends on no
other row) and split into blocks of WIDTH dimensions. Two vectors with a cosine of at least t have a squared
distance of at most 2 - 2 t, so in some block they lie within that block's share of it. Each block is a range join:
the first GRID coordinates give a cell of twice the radius, and a vector visits those later cells that its ball
touches. A pair is counted only in the first block whose share it keeps, and it meets in one unit of that block, so
each link is counted once, on the spot, from the full vectors: units give link counts per vector and the edges of a
spanning forest, never pairs. A cell of more than UNIT vectors is dealt over a grid of chunk pairs.

Equal vectors are one class with a weight. Nothing is lost: the blocks' shares add up to the whole budget.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .kernels import numbers, releasing
from .shared import Forest, components, group_values, in_units, materialize, salt_of, whole_units

WIDTH = 8
GRID = 3
#: Vectors of a chunk at 64 dimensions or less; longer ones count for more, so that a unit's bytes are bounded.
UNIT = 32768
TILE = 1024
ACROSS = 10
SLACK = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows as float64, each times a power of two that brings its largest component near 1: squares neither overflow nor vanish, and no digit changes."""
    x = x.astype(float)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def rotate(x: np.ndarray) -> np.ndarray:
    """Unit vectors (rows, float64) rotated in a space whose dimension is the next multiple of WIDTH that is a power of two."""
    norm = np.sqrt((x * x).sum(axis=1))
    d = max(WIDTH, 1 << (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x / norm[:, None]
    for seed in (41, 42):
        y *= np.where(numbers(seed, d) >> np.uint64(63), 1.0, -1.0)
        h = 1
        while h < d:
            z = y.reshape(len(y), d // (2 * h), 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), d)
            h *= 2
        y *= 1 / math.sqrt(d)
    return y


#: Pairs that are joined between two looks at the trees.
STEP = 2048


def radius(dimension: int, threshold: float) -> float:
    """The largest distance in a block of WIDTH of ``dimension`` dimensions that its share of the budget allows."""
    return math.sqrt((2 - 2 * threshold + SLACK) * WIDTH / dimension)


def visits(y: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(block, rows, cells of GRID numbers, whether at home) for all blocks: each row's own cell, and the later cells its ball touches."""
    r = radius(y.shape[1], threshold)
    side = 2 * r * 1.0001
    every = np.arange(len(y))
    for b in range(y.shape[1] // WIDTH):
        p = y[:, b * WIDTH : b * WIDTH + GRID] / side
        cell = np.floor(p).astype(np.int64)
        yield b, every, cell, True
        inner = p - cell
        step = np.where(inner < 0.5, -1, 1)
        gap = np.where(inner < 0.5, inner, 1 - inner) * side
        for moved in itertools.product((0, 1), repeat=GRID):
            m = np.array(moved)
            other = cell + step * m
            # the first coordinate that differs tells which of two cells is the later one
            later = (step * m)[:, np.flatnonzero(m)[0]] > 0 if any(moved) else np.zeros(len(y), bool)
            near = later & (((gap * m) ** 2).sum(axis=1) <= r * r * 1.0001)
            rows = np.flatnonzero(near)
            yield b, rows, other[rows], False


def place(threshold: float):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                lengths = batch.column(2).value_lengths().to_numpy()
                for d in np.unique(lengths):
                    part = batch.filter(pa.array(lengths == d))
                    x = scaled(np.asarray(part.column(2).flatten()).reshape(-1, d))
                    for b, rows, cells, home in visits(rotate(x), threshold):
                        if len(rows):
                            names = [pa.array(np.full(len(rows), v), pa.int32()) for v in (d, b)]
                            columns = [*names, *(pa.array(cells[:, g], pa.int32()) for g in range(GRID)), pa.array(np.full(len(rows), home)), *(part.column(c).take(pa.array(rows)) for c in (0, 1, 2))]
                            yield pa.RecordBatch.from_arrays(columns, names=["dim", "block", *(f"c{g}" for g in range(GRID)), "home", "id", "weight", "embedding"])

    return run


def compare(threshold: float):
    """Count the links inside units: rows ``(id, links, other)``, where ``other`` (may be null) is a forest edge."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches):
            unit = table.column("unit").to_numpy()
            bounds = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            for i, j in zip(bounds[:-1], bounds[1:]):
                if j - i > 1:
                    yield from one(table.slice(i, j - i).combine_chunks().to_batches()[0])

    def one(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = lambda c: part.column(part.schema.get_field_index(c))
        ids, weight, side = column("id").to_numpy(), column("weight").to_numpy(), column("side").to_numpy()
        block, dim = column("block")[0].as_py(), column("dim")[0].as_py()
        x = scaled(np.asarray(column("embedding").flatten()).reshape(-1, dim))
        y = rotate(x)
        limit = (2 - 2 * threshold + SLACK) * WIDTH / y.shape[1]
        norm = np.sqrt((x * x).sum(axis=1))
        z = y[:, block * WIDTH : (block + 1) * WIDTH].astype(np.float32)
        sq = (z * z).sum(axis=1)
        # 0: at home, compared with each other and the rest; ACROSS: at home, compared with the rest only; 1, 2: the rest
        here, there = np.flatnonzero((side == 0) | (side == ACROSS)), np.flatnonzero((side == 1) | (side == 2))
        links, forest, edges, lead = np.zeros(len(ids), np.int64), Forest(), [], np.arange(len(ids))
        # Pairs that are gathered at once: fewer of longer vectors.
        most = max(1000, 50_000 * 64 // max(64, dim))

        def unite(a: np.ndarray, b: np.ndarray) -> None:
            """Add forest edges; pairs of one tree are dropped as arrays, so a group of near copies takes steps in its size, not in its pairs."""
            while len(a):
                apart = lead[a] != lead[b]
                a, b = a[apart], b[apart]
                for p, q in zip(a[:STEP].tolist(), b[:STEP].tolist()):
                    if forest.join(p, q):
                        edges.append((p, q))
                if len(a):
                    lead[:] = [forest.top(k) for k in range(len(lead))]
                a, b = a[STEP:], b[STEP:]

        def pairs(a: np.ndarray, b: np.ndarray) -> None:
            first = np.zeros(len(a), np.int64)
            for k in range(y.shape[1] // WIDTH):
                if k <= block:
                    diff = y[a, k * WIDTH : (k + 1) * WIDTH] - y[b, k * WIDTH : (k + 1) * WIDTH]
                    near = (diff * diff).sum(axis=1) <= limit
                    first += near if k < block else 0
                    if k == block:
                        a, b, first = a[near], b[near], first[near]
            a, b = a[first == 0], b[first == 0]
            cosine = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b])
            a, b = a[cosine >= threshold], b[cosine >= threshold]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            unite(a, b)

        for s in range(0, len(here), TILE):
            a = here[s : s + TILE]
            for others, own in ((here[s:] if side[here[0]] == 0 else here[:0], True), (there, False)):
                for t in range(0, len(others), TILE):
                    b = others[t : t + TILE]
                    near = sq[a][:, None] + sq[b][None, :] - 2 * (z[a] @ z[b].T) <= limit + 1e-5
                    if own and t == 0:
                        near = np.triu(near, 1)
                    p, q = np.nonzero(near)
                    for u in range(0, len(p), most):
                        pairs(a[p[u : u + most]], b[q[u : u + most]])
        some = np.flatnonzero(links)
        out_id = np.concatenate([ids[some], ids[[e[0] for e in edges]]]) if edges else ids[some]
        out_links = np.concatenate([links[some], np.zeros(len(edges), np.int64)])
        out_other = [None] * len(some) + [int(ids[e[1]]) for e in edges]
        yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_links, pa.int64()), pa.array(out_other, pa.int64())], names=["id", "links", "other"])

    return run


def usable(embedding: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return embedding.isNotNull() & ~F.exists(embedding, bad) & F.exists(embedding, lambda v: v != 0)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of all rows ``(vec_id, embedding)``, linked where their cosine is at least ``threshold``.

    Vectors of different lengths, and vectors that are null, zero or hold null or non-finite components, link with
    nothing. Equal vectors link; rows that repeat a vec_id count as vectors of their own. A null vec_id is compared
    but names no component: the least id that is not null does. An empty table gives an empty result; a pair at
    exactly the threshold is linked; of equal ids as a component's least all rows are kept. A vector may have any
    length. Other columns are not read.
    """
    element = getattr(vectors.schema["embedding"].dataType, "elementType", None)
    # Floats are compared as the doubles they stand for; any other number as a double.
    kind = "float" if isinstance(element, FloatType) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    # -0.0 and 0.0 are equal numbers, so they must be equal keys.
    rows = rows.withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0.0).cast(kind)))
    rows = rows.withColumn("key", F.when(usable(F.col("embedding")), F.sha2(F.to_json("embedding").cast("binary"), 256)))
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("salt", salt_of(F.col("rid"))), "vectors")
    keyed = rows.where("key is not null")
    classes = materialize(group_values(keyed, "key", {"id": F.min("rid"), "weight": F.count("*")}), "classes")
    reps = keyed.join(classes, ["key", "salt"]).where("rid = id").select("id", "weight", "embedding")
    cells = ["dim", "block", *(f"c{g}" for g in range(GRID))]
    placed = reps.mapInArrow(place(threshold), ", ".join(f"{c} int" for c in cells) + f", home boolean, id long, weight long, embedding array<{kind}>")
    placed = materialize(placed.withColumn("salt", salt_of(F.col("id"))), "placed")
    # Cells grow with the vectors' dimension, so the join is not told to broadcast them: their table's size decides.
    full = group_values(placed, cells, {"at_home": F.count(F.when(F.col("home"), 1)), "n": F.count("*")}, F.expr("n > 1 and at_home > 0"))
    weight = F.greatest(F.lit(64), F.col("dim")) / F.lit(64 * UNIT)
    full = materialize(full.select(*cells, "salt", F.ceil(F.col("n") * weight).cast("int").alias("chunks")), "cells")
    units = placed.join(full, [*cells, "salt"]).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    place_of = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    every, mine = F.sequence(F.lit(0), F.col("chunks") - 1), F.col("mine")
    # Unit (i, j): the home rows of chunk i against each other (if i = j), the home rows of chunk j > i, and the visitors of chunk j.
    home = F.concat(F.transform(every, lambda k: place_of(mine, k, F.lit(0))), F.transform(F.filter(every, lambda k: k < mine), lambda k: place_of(k, mine, F.lit(1))))
    dealt = units.withColumn("at", F.explode(F.when(F.col("home"), home).otherwise(F.transform(every, lambda k: place_of(k, mine, F.lit(2)))))).select(
        F.xxhash64(*cells, "at.i", "at.j").alias("unit"), "dim", "block", (F.col("at.side") + F.when((F.col("at.side") == 0) & (F.col("at.i") != F.col("at.j")), ACROSS).otherwise(0)).alias("side"), "id", "weight", "embedding")
    found = materialize(in_units(dealt, compare(threshold), "id long, links long, other long"), "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    top = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    classes = classes.join(links, "id", "left").join(top.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select("key", "salt", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("node"))
    out = materialize(rows.select("vec_id", "rid", "key", "salt").join(classes, ["key", "salt"], "left").select("vec_id", "rid", "salt", "n_links", F.coalesce("node", "rid").alias("node")), "linked")
    least = group_values(out, "node", {"component_id": F.min("vec_id")})
    out = out.join(least, ["node", "salt"]).select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
