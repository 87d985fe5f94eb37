"""Distribution comparison: activity summaries, Wasserstein distances and potentials, kernel and nearest-neighbour measures, Fréchet distance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.vectors import Gaussian, RandomFeatures, frechet, median_bandwidth
from .ranking import running
from .tables import in_units, materialize, whole_units

HIT = 16.0


def activity_summary(prob: Column, mic: Column) -> list[Column]:
    """Aggregates of one activity table, or of each group of it."""
    return [
        F.count("*").alias("n"), F.avg(prob).alias("amplify_mean"), F.avg(mic).alias("mic_mean"),
        F.percentile(mic, F.lit(0.5)).alias("mic_median"), F.percentile(mic, F.lit(0.9)).alias("mic_p90"),
        F.exp(F.avg(F.log(mic))).alias("mic_geomean"), F.avg((mic <= HIT).cast("int")).alias("fraction_le_16"),
    ]


def _steps(sample: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """``(v, p, q, width)``: both ECDFs at each value of either, and the gap to the next value."""
    a = sample.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("a")).withColumn("b", F.lit(0).cast("long"))
    b = reference.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("b")).select("v", F.lit(0).cast("long").alias("a"), "b")
    both = running(a.union(b).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "v", ["a", "b"])
    return both.select("v", (F.col("a_upto") / F.col("a_total")).alias("p"), (F.col("b_upto") / F.col("b_total")).alias("q"), (F.col("next") - F.col("v")).alias("width"))


def wasserstein(sample: DataFrame, reference: DataFrame, column: str, floor: float = 0.01) -> DataFrame:
    """One row ``(wasserstein)``: 1-D distance in units of the reference's population deviation (at least ``floor``)."""
    raw = _steps(sample, reference, column).agg(F.sum(F.abs(F.col("p") - F.col("q")) * F.col("width")).alias("d"))
    scale = reference.agg(F.greatest(F.stddev_pop(column), F.lit(floor)).alias("s"))
    return raw.crossJoin(scale).select((F.col("d") / F.col("s")).alias("wasserstein"))


def wasserstein_potential(sample: DataFrame, reference: DataFrame, column: str, floor: float = 0.01) -> DataFrame:
    """``(v, potential)`` per value: the subgradient of the distance when mass is put at v, i.e. the sum of sign(P - Q) * step from v on."""
    scale = reference.agg(F.greatest(F.stddev_pop(column), F.lit(floor)).alias("s")).first()["s"]
    steps = _steps(sample, reference, column)
    part = F.coalesce(F.signum(F.col("p") - F.col("q")) * F.col("width") / F.lit(float(scale)), F.lit(0.0))
    sums = running(steps.select("v", part.alias("part")), "v", ["part"])
    return sums.select("v", (F.col("part_total") - F.col("part_upto") + F.col("part")).alias("potential"))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x.cast("double"))


def _vector_blocks(left: DataFrame, right: DataFrame, chunk: int) -> tuple[DataFrame, int]:
    """Rows ``(unit, side, id, embedding)`` of all pairs of chunks of two samples, and how many units that are."""
    n = [max(1, -(-df.count() // chunk)) for df in (left, right)]
    at = lambda k: F.pmod(F.xxhash64("id"), F.lit(n[k]))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(n[k] - 1)))
    a = left.select(at(0).alias("i"), every(1).alias("j"), F.lit(0).alias("side"), "id", "embedding")
    b = right.select(every(0).alias("i"), at(1).alias("j"), F.lit(1).alias("side"), "id", "embedding")
    return a.unionByName(b).select((F.col("i") * n[1] + F.col("j")).cast("long").alias("unit"), "side", "id", "embedding"), n[0] * n[1]


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Arrays of equal lengths as rows of a matrix, without a Python object a number; a missing number is an error."""
    arrays = column.combine_chunks()
    flat = arrays.flatten()
    if not len(arrays) or flat.null_count or len(flat) % len(arrays):
        return np.array(column.to_pylist(), float)
    return flat.to_numpy().astype(float).reshape(len(arrays), -1)


def _products(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one matrix product, and how far rounding may put them off."""
    sx, sy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    d = x @ y.T
    d *= -2
    d += sx[:, None]
    d += sy[None, :]
    return d, 1e-15 * (x.shape[1] + 8) * 4 * float(sx.max(initial=0) + sy.max(initial=0))


def _exact(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs of rows ``a[k]`` and ``b[k]`` of x, from differences."""
    out = np.empty(len(a))
    for at in range(0, len(a), 1 << 14):
        gap = x[a[at : at + (1 << 14)]] - x[b[at : at + (1 << 14)]]
        out[at : at + (1 << 14)] = np.einsum("ij,ij->i", gap, gap)
    return out


def _unit_sides(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of the two sides of each unit."""
    unit, side = (table.column(c).to_numpy() for c in ("unit", "side"))
    for u in np.unique(unit):
        a, b = np.flatnonzero((unit == u) & (side == 0)), np.flatnonzero((unit == u) & (side == 1))
        if len(a) and len(b):
            yield a, b


def kernel_sums(left: DataFrame, right: DataFrame, bandwidth: float, chunk: int = 4096) -> float:
    """Sum of exp(-d^2 / (2 bandwidth)) over pairs with different ids, from units of chunk pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches):
            ids, x, total = table.column("id").to_numpy(), _vectors(table.column("embedding")), []
            for a, b in _unit_sides(table):
                for at in range(0, len(a), 256):
                    d, _ = _products(x[a[at : at + 256]], x[b])
                    k = np.exp(np.maximum(d, 0, out=d) / (-2 * bandwidth))
                    same = np.isin(ids[a[at : at + 256]], ids[b])
                    if same.any():
                        k[same] *= ids[a[at : at + 256]][same][:, None] != ids[b][None, :]
                    total.append(float(k.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.float64())], names=["s"])

    blocks, units = _vector_blocks(left, right, chunk)
    return in_units(blocks, run, "s double", units).agg(F.sum("s").alias("s")).first()["s"] or 0.0


def mmd_unbiased(x: DataFrame, y: DataFrame, bandwidth: float) -> float:
    """Unbiased squared MMD of samples ``(id, embedding)`` under a Gaussian kernel, without the diagonals. Ids must differ between the samples."""
    n, m = x.count(), y.count()
    return kernel_sums(x, x, bandwidth) / (n * (n - 1)) + kernel_sums(y, y, bandwidth) / (m * (m - 1)) - 2 * kernel_sums(x, y, bandwidth) / (n * m)


def median_squared_distance(reference: DataFrame, most: int = 512) -> float:
    """Kernel bandwidth: median of the positive squared distances among the first ``most`` vectors ``(id, embedding)`` by id. The bound is part of the definition."""
    rows = reference.orderBy("id").limit(most).select("embedding").collect()
    return median_bandwidth(np.array([r[0] for r in rows], float), most)


def feature_means(df: DataFrame, phi: RandomFeatures, column: str = "embedding") -> np.ndarray | None:
    """Mean of the random features over all vectors; each task sends one sum, and sums are added per feature on the cluster. None without vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(len(phi.phases))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float)
            if len(x):
                n, total = n + len(x), total + phi(x).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(np.full(len(total), n), pa.int64()), pa.array(total)], names=["k", "n", "total"])

    parts = df.select(column).where(F.col(column).isNotNull()).mapInArrow(run, "k int, n long, total double")
    rows = parts.groupBy("k").agg((F.sum("total") / F.sum("n")).alias("mean")).collect()
    return np.array([r["mean"] for r in sorted(rows, key=lambda r: r["k"])]) if rows else None


def mmd_random(x: DataFrame, y: DataFrame, seed: int = 42, features: int = 256) -> float | None:
    """Biased squared MMD of all vectors ``(id, embedding)`` by random features; only the bandwidth is of the first 512 of y by id. None if either is empty."""
    y = y.where(F.col("embedding").isNotNull())
    first = y.limit(1).collect()
    if not first:
        return None
    phi = RandomFeatures.of_bandwidth(len(first[0]["embedding"]), median_squared_distance(y), seed, features)
    mx, my = feature_means(x, phi), feature_means(y, phi)
    return None if mx is None else float(((mx - my) ** 2).sum())


#: Most pivots, vectors a pivot, and vectors among which a pivot is chosen.
PIVOTS, PER_PIVOT, CHOICE = 256, 32, 16
#: Cells that any sample may have; beyond them only as many as hold so many vectors each, since on vectors without structure each is sent to all cells.
FEW_CELLS, LARGE_CELL = 64, 8192


class Pivots:
    """Vectors that cut a sample in cells, each vector in that of its nearest one.

    At most PIVOTS, from at most CHOICE times as many rows chosen by a hash of the id: the next pivot is the one
    farthest from all before it, so that clusters get pivots of their own. They deal the work and don't touch results.
    """

    def __init__(self, sample: DataFrame, chunk: int) -> None:
        n = sample.count()
        pivots = min(PIVOTS, max(1, n // PER_PIVOT), max(FEW_CELLS, n // LARGE_CELL))
        rows = sample.orderBy(F.xxhash64("id", F.lit(3)), "id").select("embedding").limit(CHOICE * pivots).collect()
        x = np.array([r["embedding"] for r in rows], float)
        chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(chosen) < min(pivots, len(x)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        self.x, self.chunk, self.n = x[chosen], chunk, n

    def distances(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.x)))
        for k in range(0, len(x), 256):
            gap = x[k : k + 256, None, :] - self.x[None, :, :]
            out[k : k + 256] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
        return out

    def placed(self, df: DataFrame) -> DataFrame:
        """``df`` with ``cell`` and ``away``, the distance to its pivot."""
        distances = self.distances

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = distances(_vectors(pa.chunked_array([batch.column(batch.schema.get_field_index("embedding"))])))
                    cell = d.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*batch.schema.names, "cell", "away"])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())]))

    def meeting(self, queries: DataFrame, bases: DataFrame, margin: np.ndarray, chunks: np.ndarray) -> DataFrame:
        """Rows ``(unit, side, id, embedding, value)``: each query ``(id, embedding, reach)`` with the bases ``(id, embedding, value, cell, part)`` of the cells that it may meet.

        By the triangle inequality a query meets nothing of a cell whose pivot is farther than its own reach and the
        cell's margin. Cells are dealt in parts of a chunk, and the queries of a part in groups; only the bases of
        groups that exist are copied.
        """
        distances, groups = self.distances, max(1, self.n // (8 * self.chunk))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = distances(_vectors(pa.chunked_array([batch.column(1)])))
                    row, cell = np.nonzero(d <= (margin[None, :] + batch.column(2).to_numpy()[:, None]) * (1 + 1e-9) + 1e-12)
                    row, part = np.repeat(row, chunks[cell]), np.concatenate([*(np.arange(chunks[c]) for c in cell), np.zeros(0, np.int64)])
                    cell = np.repeat(cell, chunks[cell])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in (0, 1)), pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32))], names=["id", "embedding", "cell", "part"])

        kind = queries.schema["embedding"].dataType.simpleString()
        sent = queries.select("id", "embedding", "reach").mapInArrow(run, f"id long, embedding {kind}, cell int, part int").withColumn("grp", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(groups)).cast("int"))
        sent = materialize(sent, "sent")
        met = bases.join(sent.select("cell", "part", "grp").distinct(), ["cell", "part"])
        unit = F.xxhash64("cell", "part", "grp").alias("unit")
        left = sent.select(unit, F.lit(0).alias("side"), "id", "embedding", F.lit(None).cast("double").alias("value"))
        return left.unionByName(met.select(unit, F.lit(1).alias("side"), "id", F.col("embedding").cast(kind).alias("embedding"), F.col("value").cast("double").alias("value")))


def _cells(placed: DataFrame, cells: int, value: Column, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per cell: rows, the greatest ``value``, and parts of a chunk."""
    n, top = np.zeros(cells, np.int64), np.full(cells, -np.inf)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max(value).alias("top")).collect():
        n[r["cell"]], top[r["cell"]] = r["n"], r["top"]
    return n, top, -(-n // chunk)


def _parts(chunks: np.ndarray) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(4)), F.greatest(F.lit(1), F.element_at(F.array(*(F.lit(int(c)) for c in chunks)), F.col("cell") + 1))).cast("int")


def knn_units(sample: DataFrame, k: int = 3, chunk: int = 8192) -> DataFrame:
    """The units in which each vector meets all that may be among its k nearest: ``(unit, side, id, embedding, value)``.

    A vector's k-th distance is bounded by that inside its own part of its cell, and by cells near its pivot that hold
    k others in all; it meets the cells within that bound.
    """
    pivots = Pivots(sample, chunk)
    placed = materialize(pivots.placed(sample.select("id", "embedding")), "placed")
    n, radius, chunks = _cells(placed, len(pivots.x), F.col("away"), chunk)
    # The least distance from a pivot within which whole cells hold more than k vectors.
    reach, enough = pivots.distances(pivots.x) + np.maximum(radius, 0)[None, :], np.full(len(n), np.inf)
    for c in range(len(n)):
        order = np.argsort(reach[c])
        full = np.flatnonzero(np.cumsum(n[order]) > k)
        enough[c] = reach[c][order[full[0]]] if len(full) else np.inf

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches):
            unit, away, cell = (table.column(c).to_numpy() for c in ("unit", "away", "cell"))
            x, out = _vectors(table.column("embedding")), away + enough[cell]
            for u in np.unique(unit):
                mine = np.flatnonzero(unit == u)
                for at in range(0, len(mine) if len(mine) > k else 0, 128):
                    some = mine[at : at + 128]
                    d, off = _products(x[some], x[mine])
                    out[some] = np.minimum(out[some], np.sqrt(np.maximum(np.partition(d, k, axis=1)[:, k], 0) + off))
            yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("id", "embedding")), pa.array(out), *(table.column(c).combine_chunks() for c in ("cell", "part"))], names=["id", "embedding", "reach", "cell", "part"])

    kind = sample.schema["embedding"].dataType.simpleString()
    rows = placed.withColumn("part", _parts(chunks)).withColumn("unit", F.xxhash64("cell", "part"))
    rows = materialize(in_units(rows, bound, f"id long, embedding {kind}, reach double, cell int, part int"), "bounded")
    return pivots.meeting(rows, rows.withColumn("value", F.lit(0.0)), radius, chunks)


def knn_radius(sample: DataFrame, k: int = 3, chunk: int = 8192) -> DataFrame:
    """``(id, radius2)``: squared distance to the k-th nearest other vector. Units send their k + 1 nearest per vector, one aggregate merges them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches):
            ids, found, name, x = [np.zeros(0, np.int64)], [np.zeros(0)], table.column("id").to_numpy(), _vectors(table.column("embedding"))
            for a, b in _unit_sides(table):
                for at in range(0, len(a), 128):
                    some = a[at : at + 128]
                    d, off = _products(x[some], x[b])
                    # Those that rounding leaves among the nearest are measured from differences.
                    near = np.partition(d, k, axis=1)[:, k] if len(b) > k + 1 else np.full(len(some), np.inf)
                    p, q = np.nonzero(d <= near[:, None] + 2 * off)
                    exact = _exact(x, some[p], b[q])
                    order = np.lexsort((exact, p))
                    first = order[np.arange(len(p)) - np.searchsorted(p[order], p[order]) <= k]  # k + 1 a vector, however many copies it has
                    ids.append(name[some[p[first]]])
                    found.append(exact[first])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(found))], names=["id", "d"])

    near = in_units(knn_units(sample, k, chunk), run, "id long, d double")
    return near.groupBy("id").agg(F.get(F.array_sort(F.collect_list("d")), k).alias("radius2"))


def covered(points: DataFrame, manifold: DataFrame, k: int = 3, chunk: int = 8192) -> float:
    """Share of the points inside some ball around a vector of ``manifold`` that reaches its k-th neighbour.

    A point meets the balls of the cells that reach as far as it.
    """
    balls = manifold.select("id", "embedding").join(knn_radius(manifold, k, chunk), "id").where("radius2 IS NOT NULL")
    pivots = Pivots(manifold, chunk)
    placed = materialize(pivots.placed(balls), "balls")
    _, margin, chunks = _cells(placed, len(pivots.x), F.col("away") + F.sqrt("radius2"), chunk)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches):
            hit = [np.zeros(0, np.int64)]
            ids, value, x = table.column("id").to_numpy(), table.column("value").to_numpy(), _vectors(table.column("embedding"))
            for a, b in _unit_sides(table):
                for at in range(0, len(a), 128):
                    some = a[at : at + 128]
                    d, off = _products(x[some], x[b])
                    d -= value[b]
                    inside = (d < -2 * off).any(axis=1)
                    p, q = np.nonzero((np.abs(d) <= 2 * off) & ~inside[:, None])  # on the border: measured from differences
                    inside[p[_exact(x, some[p], b[q]) <= value[b[q]]]] = True
                    hit.append(ids[some[inside]])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(hit)), pa.int64())], names=["id"])

    units = pivots.meeting(points.select("id", "embedding").withColumn("reach", F.lit(0.0)), placed.withColumn("value", F.col("radius2")).withColumn("part", _parts(chunks)), margin, chunks)
    return in_units(units, run, "id long").distinct().count() / points.count()


def precision_recall(x: DataFrame, y: DataFrame, k: int = 3) -> tuple[float | None, float | None]:
    """kNN-manifold precision and recall of the sample x against y; None if either has at most k vectors. Ids must differ between the samples."""
    if min(x.count(), y.count()) <= k:
        return None, None
    return covered(x, y, k), covered(y, x, k)


def moments(df: DataFrame, column: str = "embedding") -> Gaussian:
    """Count, mean and scatter; each task sends one d x d part."""

    def merge(parts: Iterator[Gaussian]) -> Iterator[pa.RecordBatch]:
        total: Gaussian | None = None
        for g in parts:
            total = g if total is None else total.merged(g)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.n], pa.int64()), pa.array([total.mean.tolist()]), pa.array([total.scatter.ravel().tolist()])], names=["n", "mean", "scatter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return merge(Gaussian.of(np.array(b.column(0).to_pylist(), float)) for b in batches if b.num_rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Gaussian]:
        for batch in batches:
            for r in batch.to_pylist():
                yield Gaussian(r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(len(r["mean"]), -1))

    schema = "n long, mean array<double>, scatter array<double>"
    parts = df.select(column).where(F.col(column).isNotNull()).mapInArrow(run, schema)
    # Two levels, so that the driver merges at most 32 parts however many tasks there are.
    some = parts.repartition(32).mapInArrow(lambda batches: merge(read(batches)), schema).collect()
    total = Gaussian(0, np.zeros(0), np.zeros((0, 0)))
    for r in some:
        g = Gaussian(r["n"], np.array(r["mean"]), np.array(r["scatter"]).reshape(len(r["mean"]), -1))
        total = total.merged(g) if total.n else g
    return total


def frechet_distance(x: DataFrame, y: DataFrame, column: str = "embedding") -> float | None:
    return frechet(moments(x, column), moments(y, column))


def histogram(df: DataFrame, column: str, domain: DataFrame | None = None) -> DataFrame:
    """``(column, n, weight)``; with a ``domain`` of values, those without rows count 0."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    if domain is not None:
        counts = domain.select(column).distinct().join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
    return counts.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def histogram_l1(sample: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """One row ``(l1)``: sum of absolute differences of two histograms' weights."""
    a, b = histogram(sample, column).select(column, F.col("weight").alias("a")), histogram(reference, column).select(column, F.col("weight").alias("b"))
    return a.join(b, column, "full_outer").agg(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))).alias("l1"))


def covered_mass(selected: DataFrame, weights: DataFrame, column: str) -> DataFrame:
    """One row ``(mass)``: the weights of the regions that have a selected row."""
    return weights.join(selected.select(column).distinct(), column, "left_semi").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("mass"))


def repeated(seeds: Sequence[int], measure) -> tuple[float, float]:
    """Mean and population deviation of ``measure(seed)``."""
    values = np.array([measure(s) for s in seeds], float)
    return float(values.mean()), float(values.std())
