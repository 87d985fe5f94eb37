"""Fitted steps: projections, regions, proxy classifier, and the contracts for external scorers, embedders and samplers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.residues import z_score
from ..functions.vectors import REACH, SIDE, STEP, RandomFeatures, lattice_sums
from .distributions import moments, squared_distance
from .ranking import running
from .tables import in_units, materialize, whole_units


def center(df: DataFrame, mean: np.ndarray, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, F.zip_with(column, F.array(*(F.lit(float(m)) for m in mean)), lambda x, m: x - m))


def principal_components(reference: DataFrame, tables: list[DataFrame], k: int = 16, column: str = "embedding", out: str = "pc") -> list[DataFrame]:
    """Project on the reference's k first components, scaled by its mean radius there. A component's sign is arbitrary."""
    mean = moments(reference, column).mean
    prepared = [center(t, mean, column).withColumn("_v", array_to_vector(column)) for t in (reference, *tables)]
    model = PCA(k=min(k, len(mean)), inputCol="_v", outputCol="_p").fit(prepared[0])
    done = [model.transform(t).withColumn(out, vector_to_array("_p")).drop("_v", "_p") for t in prepared]
    radius = done[0].agg(F.sqrt(F.avg(F.aggregate(out, F.lit(0.0), lambda s, x: s + x * x))).alias("r")).first()["r"] or 1.0
    return [t.withColumn(out, F.transform(out, lambda x: x / F.lit(max(radius, 1e-6)))) for t in done[1:]]


def moment_features(df: DataFrame, column: str = "pc", out: str = "moments") -> DataFrame:
    """All products of at most two components."""
    model = PolynomialExpansion(degree=2, inputCol="_v", outputCol="_m")
    return model.transform(df.withColumn("_v", array_to_vector(column))).withColumn(out, vector_to_array("_m")).drop("_v", "_m")


def regions(reference: DataFrame, tables: list[DataFrame], k: int | None = None, column: str = "pc", most: int = 48, per_region: int = 40, seed: int = 42) -> tuple[list[DataFrame], DataFrame]:
    """K-means regions of the reference: the tables with ``region``, and ``(region, weight)`` of the reference."""
    n = reference.count()
    k = k or min(most, max(2, n // per_region), n)
    model = KMeans(k=k, seed=seed, maxIter=30, featuresCol="_v", predictionCol="region").fit(reference.withColumn("_v", array_to_vector(column)))
    put = lambda t: model.transform(t.withColumn("_v", array_to_vector(column))).drop("_v")
    share = put(reference).groupBy("region").agg((F.count("*") / F.lit(n)).alias("weight"))
    weights = reference.sparkSession.range(k).select(F.col("id").cast("int").alias("region")).join(share, "region", "left")
    return [put(t) for t in tables], weights.select("region", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def scaled_properties(df: DataFrame, reference: DataFrame, columns: tuple[str, ...] = ("length", "charge", "hydrophobicity", "moment"), out: str = "pc") -> DataFrame:
    """``df`` with ``out``: the columns as one array, each in the reference's standard deviations from its mean (a deviation below 0.01 counts as that)."""
    stats = reference.agg(*(f(c).alias(f"_{n}{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    both = df.crossJoin(F.broadcast(stats))  # one row
    return both.withColumn(out, F.array(*(z_score(F.col(c), F.col(f"_m{c}"), F.col(f"_s{c}")) for c in columns))).drop(*stats.columns)


def proxy_classifier(labelled: DataFrame, features: str = "features", label: str = "label", trees: int = 200, least: int = 20, seed: int = 42, audit: DataFrame | None = None) -> tuple[object, dict[str, float]] | None:
    """Random forest on array features with class weights, and its areas under the ROC and precision-recall curves; None with fewer than ``least`` negatives.

    The areas are of the held-out rows ``audit`` (no areas if these lack a class), or without it of the rows fitted on.
    """
    counts = {r[0]: r[1] for r in labelled.groupBy(label).agg(F.count("*")).collect()}
    if counts.get(0, 0) < least:
        return None
    total = sum(counts.values())
    weight = F.when(F.col(label) == 1, total / (2 * max(1, counts.get(1, 0)))).otherwise(total / (2 * counts[0]))
    data = labelled.withColumn("_v", array_to_vector(features)).withColumn("_w", weight).withColumn("_y", F.col(label).cast("double"))
    model = RandomForestClassifier(featuresCol="_v", labelCol="_y", weightCol="_w", numTrees=trees, minInstancesPerNode=3, seed=seed).fit(data)
    done = model.transform(data if audit is None else audit.withColumn("_v", array_to_vector(features)).withColumn("_y", F.col(label).cast("double")))
    if audit is not None and audit.select(label).where(F.col(label).isin(0, 1)).distinct().count() < 2:
        return model, {}
    area = lambda m: BinaryClassificationEvaluator(labelCol="_y", metricName=m).evaluate(done)
    return model, {"auroc": area("areaUnderROC"), "average_precision": area("areaUnderPR")}


def nearest_code(df: DataFrame, codes: DataFrame, column: str = "embedding", code: str = "code") -> DataFrame:
    """``df`` with the code whose vector is nearest (ties: least code). ``codes (code, vector)`` is a code book of a few rows; more than 1000 is an error."""
    book = codes.orderBy(code).limit(1001).collect()
    if len(book) > 1000:
        raise ValueError("a code book has at most 1000 rows")
    each = [F.struct(squared_distance(F.col(column), F.array(*(F.lit(float(x)) for x in r[1]))).alias("d"), F.lit(r[0]).alias("c")) for r in book]
    return df.withColumn(code, F.array_min(F.array(*each))["c"])


def score_with(seqs: DataFrame, scorer: Callable[[list[str]], dict[str, np.ndarray]], columns: list[str], batch: int = 20_000) -> DataFrame:
    """``(seq, columns)`` from an external scorer of lists of sequences; a missing or non-finite score is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame["seq"].iloc[at : at + batch].tolist()
                got = {c: np.asarray(v, float) for c, v in scorer(part).items() if c in columns}
                if set(got) != set(columns) or any(len(v) != len(part) or not np.isfinite(v).all() for v in got.values()):
                    raise ValueError("the scorer left scores out")
                yield pd.DataFrame({"seq": part} | got)

    return seqs.select("seq").mapInPandas(run, "seq string, " + ", ".join(f"`{c}` double" for c in columns))


def generate_with(conditions: DataFrame, sampler: Callable[[np.ndarray, int], list[str]], columns: list[str], seed: int = 42, batch: int = 10_000) -> DataFrame:
    """``(draw, seq)`` from a conditional sampler of rows of conditions, called once for each run of ``batch`` draw numbers.

    A run's seed is that of its first number and its rows are in their order, so the result does not depend on partitions.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("draw")
        made = sampler(frame[columns].to_numpy(float), seed + int(frame["draw"].iloc[0]) // batch * batch)
        if len(made) != len(frame):
            raise ValueError("the sampler left draws out")
        return pd.DataFrame({"draw": frame["draw"], "seq": made})

    return conditions.select("draw", *columns).groupBy(F.floor(F.col("draw") / batch).alias("_run")).applyInPandas(run, "draw long, seq string")


def random_features(df: DataFrame, fit: RandomFeatures, column: str = "embedding", out: str = "rff") -> DataFrame:
    @F.pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(list(fit(np.array(x.tolist(), float)))) if len(x) else pd.Series([], dtype=object)

    return df.withColumn(out, apply(column))


#: Distinct vectors from which a lattice is faster than all pairs, and columns up to which it is made.
LATTICE_ROWS, LATTICE_COLUMNS = 1 << 16, 4


def _lattice_densities(vectors: DataFrame, keys: list[str], mean: np.ndarray, width: np.ndarray) -> DataFrame:
    """``(*keys, density)`` by a lattice: each vector goes to the tiles within its reach, whose nodes' sums come back. Work grows with the vectors, not with their pairs."""
    d = len(keys)
    z = [F.greatest(F.lit(-1e9), F.least(F.lit(1e9), (F.col(k) - F.lit(float(m))) / F.lit(float(w)))).alias(f"z{k}") for k, m, w in zip(keys, mean, width)]
    vectors = materialize(vectors.select(F.monotonically_increasing_id().alias("id"), *keys, "weight", *z), "numbered")
    tiles = vectors.select("id", "weight", *(f"z{k}" for k in keys))
    for n, k in enumerate(keys):
        low, high = (F.floor(f((F.col(f"z{k}") + x) / STEP) / SIDE) for f, x in ((F.ceil, -REACH), (F.floor, REACH)))
        tiles = tiles.withColumn(f"t{n}", F.explode(F.sequence(low, high)))
    first = lambda n: F.col(f"t{n}") * (SIDE * STEP)
    away = [F.greatest(first(n) - F.col(f"z{k}"), F.col(f"z{k}") - first(n) - (SIDE - 1) * STEP, F.lit(0.0)) for n, k in enumerate(keys)]
    tiles = tiles.where(sum((x * x for x in away), F.lit(0.0)) <= REACH * REACH + 1e-6)
    tiles = tiles.withColumn("unit", F.xxhash64(*(f"t{n}" for n in range(d))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches):
            ids, weight = table.column("id").to_numpy(), table.column("weight").to_numpy()
            at = np.column_stack([table.column(f"t{n}").to_numpy() for n in range(d)])
            x = np.column_stack([table.column(f"z{k}").to_numpy() for k in keys])
            order = np.lexsort((ids, *at.T))  # in a fixed order, so that sums repeat
            for some in np.split(order, np.flatnonzero((np.diff(at[order], axis=0) != 0).any(axis=1)) + 1):
                if weight[some].any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(lattice_sums(x[some], weight[some], at[some[0]]))], names=["id", "part"])

    parts = in_units(tiles, run, "id long, part double", tiles.sparkSession.sparkContext.defaultParallelism * 4)
    dense = parts.groupBy("id").agg(F.aggregate(F.array_sort(F.collect_list("part")), F.lit(0.0), lambda s, v: s + v).alias("density"))
    return vectors.join(dense, "id", "left").select(*keys, F.coalesce("density", F.lit(0.0)).alias("density"))


def conformity_scores(df: DataFrame, reference: DataFrame, columns: list[str], out: str = "conformity", chunk: int = 8192) -> DataFrame:
    """Density conformity to all rows of ``reference``: the share of them that is no denser; null where a column is null.

    Densities are Gaussian product kernels with Silverman's bandwidth, once for each distinct vector: summed in units of
    chunk pairs, or of many vectors with few columns in tiles of a lattice; ranks are two-level sums over the densities.
    """
    d, keys = len(columns), [f"_{k}" for k in range(len(columns))]
    values = [F.col(c).cast("double").alias(k) for c, k in zip(columns, keys)]
    own, ref = df.select(*values).dropna(), reference.select(*values).dropna()
    stats = ref.agg(F.count("*").alias("n"), *(F.avg(k).alias(f"m{k}") for k in keys), *(F.stddev_pop(k).alias(f"s{k}") for k in keys)).first()
    if not stats["n"]:
        return df.withColumn(out, F.lit(None).cast("double"))
    mean = np.array([stats[f"m{k}"] for k in keys])
    width = np.maximum([stats[f"s{k}"] for k in keys], 1e-12) * (stats["n"] * (d + 2) / 4) ** (-1 / (d + 4)) * np.sqrt(2)
    both = own.withColumn("weight", F.lit(0)).unionByName(ref.withColumn("weight", F.lit(1)))
    vectors = materialize(both.groupBy(*keys).agg(F.sum("weight").cast("double").alias("weight")), "vectors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches):
            unit, side, weight = (table.column(c).to_numpy() for c in ("unit", "side", "weight"))
            x = np.column_stack([table.column(k).to_numpy() for k in keys])
            for u in np.unique(unit):
                a, b = (np.flatnonzero((unit == u) & (side == k)) for k in (0, 1))
                # In a fixed order, so that sums repeat.
                a, b = (w[np.lexsort(x[w].T)] for w in (a, b))
                za, zb = (x[a] - mean) / width, (x[b] - mean) / width
                square, total = (zb * zb).sum(axis=1), np.zeros(len(a))
                for k in range(0, len(a), 256):
                    z = za[k : k + 256]
                    gap = z @ (2 * zb.T)
                    gap -= square
                    gap -= (z * z).sum(axis=1)[:, None]
                    np.minimum(gap, 0, out=gap)
                    total[k : k + 256] = np.exp(gap, out=gap) @ weight[b]
                yield pa.RecordBatch.from_arrays([*(pa.array(x[a, c]) for c in range(d)), pa.array(total)], names=[*keys, "part"])

    sizes = [t.count() for t in (vectors, vectors.where("weight > 0"))]
    n = [max(1, -(-x // chunk)) for x in sizes]
    at = lambda k: F.pmod(F.xxhash64(*keys), F.lit(n[k]))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(n[k] - 1)))
    left = vectors.select(at(0).alias("i"), every(1).alias("j"), F.lit(0).alias("side"), *keys, "weight")
    right = vectors.where("weight > 0").select(every(0).alias("i"), at(1).alias("j"), F.lit(1).alias("side"), *keys, "weight")
    blocks = left.unionByName(right).select((F.col("i") * n[1] + F.col("j")).cast("long").alias("unit"), "side", *keys, "weight")
    parts = in_units(blocks, run, ", ".join(f"{k} double" for k in keys) + ", part double")
    dense = parts.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list("part")), F.lit(0.0), lambda s, v: s + v).alias("density"))
    if sizes[1] >= LATTICE_ROWS and d <= LATTICE_COLUMNS:
        dense = _lattice_densities(vectors, keys, mean, width)
    placed = materialize(vectors.join(dense, keys), "densities")
    ranks = running(placed.groupBy("density").agg(F.sum("weight").alias("n")), "density", ["n"])
    done = placed.join(ranks.select("density", (F.col("n_upto") / F.col("n_total")).alias(out)), "density").select(*keys, out)
    return df.withColumns({k: F.col(c).cast("double") for c, k in zip(columns, keys)}).join(done, keys, "left").drop(*keys)


def training_rows(seqs: DataFrame, means: dict[str, float], deviations: dict[str, float], width: int = 50) -> DataFrame:
    """``(seq, tokens, length, conditions)``: padded letter indices, length, and z-scored properties."""
    from ..functions.residues import properties, tokens, z_score

    props = properties(F.col("seq"))
    return seqs.select("seq", tokens(F.col("seq"), width).alias("tokens"), F.length("seq").alias("length"), F.array(*(z_score(props[k], F.lit(means[k]), F.lit(deviations[k])) for k in props)).alias("conditions"))
