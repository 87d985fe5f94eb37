"""Bundles of measures over a library: sequence metrics, embedding metrics, reference floors, property errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lcs import lcs_column
from . import distributions, ranking, sets, similarity
from .tables import materialize


def normalized_mae(df: DataFrame, actual: Sequence[str], target: Sequence[str], scale: Sequence[float]) -> DataFrame:
    """One row: per column the mean absolute error in units of its scale."""
    return df.agg(*(F.avg(F.abs(F.col(a) - F.col(t)) / F.lit(float(s))).alias(a) for a, t, s in zip(actual, target, scale)))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def pair_diversity(df: DataFrame, pairs: int = 4000, key: str = "seq", seed: int = 42) -> DataFrame:
    """One row ``(diversity)``: mean of 1 - similarity over pairs of neighbours in a hash order of a bounded sample of 2 * pairs rows."""
    sample = ranking.hash_sample(df, key, 2 * pairs, seed).select(key).collect()
    rows = [(sample[k][0], sample[k + 1][0]) for k in range(0, len(sample) - 1, 2)]
    both = df.sparkSession.createDataFrame(rows, "a string, b string")
    ratio = 2 * lcs_column(F.col("a"), F.col("b")) / (F.length("a") + F.length("b"))
    return both.agg(F.avg(1 - ratio).alias("diversity"))


def sequence_metrics(seqs: DataFrame, known: DataFrame, n: int = 2000, seed: int = 42) -> DataFrame:
    """One row of sequence measures: uniqueness and exact overlap over all rows, similarity measures over a hash sample of n."""
    seqs, known = materialize(seqs.select("seq"), "seqs"), materialize(known, "known")  # read several times: made once
    total = seqs.agg(F.count("*").alias("rows"), (F.count_distinct("seq") / F.count("*")).alias("unique_fraction"))
    exact = sets.overlap(seqs, known).agg(F.count("*").alias("exact"))
    sample = materialize(ranking.hash_sample(seqs.select("seq").distinct(), "seq", n, seed), "sample")
    best = similarity.max_similarity(sample, known).agg(
        F.percentile(2 * F.col("best_lcs") / F.col("best_total"), F.lit(0.5)).alias("known_max_median"),
        F.avg((5 * F.col("best_lcs") <= 2 * F.col("best_total")).cast("int")).alias("known_le_fraction"),
    )
    near = similarity.neighbor_counts(sample).agg(F.avg((F.col("neighbors") > 0).cast("int")).alias("near_duplicate_fraction"))
    groups = similarity.greedy_clusters(sample).agg(F.count_distinct("representative").alias("clusters"))
    out = total
    for one in (exact, best, near, groups, pair_diversity(sample, n // 2, seed=seed)):
        out = out.crossJoin(one)  # one row each
    return out.withColumn("exact_known_fraction", F.col("exact") / F.col("rows")).drop("exact")


def embedding_metrics(x: DataFrame, reference: DataFrame, n: int, seeds: Sequence[int], bandwidth: float | None = None) -> dict[str, tuple[float, float]]:
    """Mean and deviation over seeded hash samples of n vectors ``(id, embedding)``: Fréchet, MMD, precision, recall. Ids must differ between the two."""
    bandwidth = bandwidth or distributions.median_squared_distance(reference)
    cut = lambda df, s: ranking.hash_sample(df, "id", n, s)
    return {
        "fbd": distributions.repeated(seeds, lambda s: distributions.frechet_distance(cut(x, s), cut(reference, s))),
        "mmd2": distributions.repeated(seeds, lambda s: distributions.mmd_unbiased(cut(x, s), cut(reference, s), bandwidth)),
        "precision": distributions.repeated(seeds, lambda s: distributions.precision_recall(cut(x, s), cut(reference, s))[0]),
        "recall": distributions.repeated(seeds, lambda s: distributions.precision_recall(cut(x, s), cut(reference, s))[1]),
    }


def reference_floor(reference: DataFrame, seeds: Sequence[int], bandwidth: float = 1.0) -> dict[str, tuple[float, float]]:
    """What two disjoint halves of the reference score against each other: the best that a library can reach."""
    halves = {s: ranking.hash_halves(reference, "id", s) for s in seeds}
    near = {s: distributions.precision_recall(*halves[s]) for s in seeds}
    return {
        "fbd": distributions.repeated(seeds, lambda s: distributions.frechet_distance(*halves[s])),
        "mmd2": distributions.repeated(seeds, lambda s: distributions.mmd_unbiased(*halves[s], bandwidth)),
        "precision": distributions.repeated(seeds, lambda s: near[s][0]),
        "recall": distributions.repeated(seeds, lambda s: near[s][1]),
    }
