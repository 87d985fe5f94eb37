"""Quotas over strata, family-preserving splits, and shortages. The state is one row per stratum or family size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import lookup


def _level(n: float, weights: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """``min(capacity, level * weights)`` with sum n: strata fill up in the order of capacity / weight, so one sort finds the level."""
    weights = np.maximum(weights / weights.max(), 1e-200)
    full_at = capacity / weights
    order = np.argsort(full_at, kind="stable")
    filled = np.concatenate([[0.0], np.cumsum(capacity[order])])[:-1]
    open_weight = np.cumsum(weights[order][::-1])[::-1]
    levels = (n - filled) / open_weight
    reached = np.flatnonzero(levels <= full_at[order])
    return np.minimum(capacity, (levels[reached[0]] if len(reached) else np.inf) * weights)


def water_fill(n: int, weights: Sequence[float], capacity: Sequence[int]) -> np.ndarray:
    """Whole quotas with sum n, proportional to the weights, none above its capacity.

    What the capacities of weighted strata cannot hold goes to those of weight zero in equal shares. Fractions go to
    the largest remainders, ties to the first.
    """
    w, cap = np.asarray(weights, float), np.asarray(capacity, int)
    if w.ndim != 1 or w.shape != cap.shape or not np.isfinite(w).all() or (w < 0).any() or (cap < 0).any() or not 1 <= n <= cap.sum():
        raise ValueError("invalid count, weights or capacities")
    share, some = np.zeros(len(w)), w > 0
    first = min(n, int(cap[some].sum()))
    if first:
        share[some] = _level(first, w[some], cap[some].astype(float))
    if n > first:
        share[~some] = _level(n - first, np.ones(int((~some).sum())), cap[~some].astype(float))
    quota = np.minimum(np.floor(share + 1e-10).astype(int), cap)
    by_rest = np.argsort(quota - share, kind="stable")
    by_rest = by_rest[quota[by_rest] < cap[by_rest]]
    quota[by_rest[: n - int(quota.sum())]] += 1
    if quota.sum() != n:
        raise RuntimeError("quotas do not add up")
    return quota


def allocate(strata: DataFrame, n: int, key: str, weight: str = "weight", capacity: str = "capacity") -> DataFrame:
    """``(key, quota)`` of a table with one row per stratum, ordered by key."""
    rows = strata.select(key, weight, capacity).orderBy(key).collect()
    quota = water_fill(n, [r[1] for r in rows], [r[2] for r in rows])
    return strata.sparkSession.createDataFrame([(r[0], int(q)) for r, q in zip(rows, quota)], f"`{key}` {strata.schema[key].dataType.simpleString()}, quota long")


def largest_remainder(strata: DataFrame, n: int, key: str, weight: str = "weight") -> DataFrame:
    """``(key, quota)`` without capacities: floors of the shares, the rest to the largest fractions (ties by key)."""
    whole = Window.partitionBy(F.lit(0))
    share = strata.withColumn("_share", n * F.col(weight) / F.sum(weight).over(whole))
    share = share.withColumn("_floor", F.floor(F.col("_share") + 1e-10)).withColumn("_left", n - F.sum("_floor").over(whole))
    place = F.row_number().over(whole.orderBy(F.desc(F.round(F.col("_share") - F.col("_floor"), 9)), key))
    return share.select(key, (F.col("_floor") + F.when(place <= F.col("_left"), 1).otherwise(0)).cast("long").alias("quota"))


def quota_selection(df: DataFrame, n: int, group: str, quotas: DataFrame, order: Sequence) -> DataFrame:
    """Take each group's quota; if that leaves fewer than n rows, fill up from the best of all the rest."""
    ranked = df.join(quotas, group).withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    first = ranked.where(F.col("_place") <= F.col("quota"))
    missing = n - first.count()
    rest = ranked.where(F.col("_place") > F.col("quota")).orderBy(*order).limit(max(0, missing))
    return first.union(rest).drop("_place", "quota")


def shortages(strata: DataFrame, key: str, desired: str = "desired", capacity: str = "capacity") -> DataFrame:
    """One row ``(key, copy)`` for each unit that a stratum lacks."""
    lack = F.greatest(F.lit(0), F.col(desired) - F.col(capacity)).cast("int")
    return strata.withColumn("_lack", lack).where("_lack > 0").select(key, F.explode(F.sequence(F.lit(1), F.col("_lack"))).alias("copy"))


def hash_split(members: DataFrame, percent: dict[str, int], family: str = "family", seed: int = 42) -> DataFrame:
    """``members`` with ``split``: whole families go to the splits by a hash of their name, close to the shares in percent.

    No family is counted and nothing is shuffled; a family keeps its split when others come or go.
    """
    if sum(percent.values()) != 100 or min(percent.values()) < 0:
        raise ValueError("the shares must add up to 100 percent")
    point = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(family)), 256), 1, 8), 16, 10).cast("long") % 100
    split, upto = F.lit(None).cast("string"), 100
    for name, share in reversed(percent.items()):
        split = F.when(point < upto, F.lit(name)).otherwise(split)
        upto -= share
    return members.withColumn("split", split)


def split_families(members: DataFrame, shares: dict[str, float], key: str = "seq", family: str = "family", label: str = "label", seed: int = 42) -> DataFrame:
    """``(key, split)``: whole families are dealt to the splits so that each class comes close to its shares.

    Families go from the largest to the smallest (equal ones by a hash), each to the split where it lowers the sum of
    squared relative deviations most. Only counts decide, so families of the same class counts are dealt as blocks:
    the driver gets one row per kind of family (not per family or member) and deals a kind in one step, and families
    of a kind are numbered inside slices of their hash, so no kind is one task.
    """
    counts = members.groupBy(family, label).agg(F.count("*").alias("n"))
    kinds = counts.groupBy(family).agg(F.sort_array(F.collect_list(F.struct(label, "n"))).alias("kind"), F.sum("n").alias("size"))
    # 4096 slices in the order of the hash: the sizes of a kind's slices say where each begins.
    kinds = kinds.withColumn("hash", F.xxhash64(F.lit(seed), family)).withColumn("slice", F.shiftright("hash", 52))
    sizes = kinds.groupBy("kind", "size", "slice").agg(F.count("*").alias("m"))
    starts = sizes.withColumn("base", F.sum("m").over(Window.partitionBy("kind").orderBy("slice")) - F.col("m"))
    place = F.row_number().over(Window.partitionBy("kind", "slice").orderBy("hash", family))
    kinds = kinds.withColumn("inside", place).join(starts.select("kind", "slice", "base"), ["kind", "slice"]).withColumn("place", F.col("base") + F.col("inside"))
    table = sizes.groupBy("kind", "size").agg(F.sum("m").alias("m")).collect()
    table = sorted(table, key=lambda r: (-r["size"], str(r["kind"])))
    labels = sorted({k[0] for r in table for k in r["kind"]}, key=str)
    column = {x: k for k, x in enumerate(labels)}
    per_family = np.zeros((len(table), len(labels)))
    for number, r in enumerate(table):
        for x, n in r["kind"]:
            per_family[number, column[x]] = n
    number_of = np.array([r["m"] for r in table], float)
    names = list(shares)
    target = np.outer([shares[s] for s in names], number_of @ per_family)
    weight, held = 1 / np.maximum(target, 1.0), np.zeros_like(target)
    plan: list[tuple[int, int, int, str]] = []
    for number, add in enumerate(per_family):
        # The k-th family of a kind costs a split ``cost + rise * (k - 1)``: taking the cheapest each time fills all to one level.
        cost = (weight * (2 * (held - target) * add + add**2)).sum(axis=1)
        rise = 2 * (weight * add**2).sum(axis=1)
        m = int(number_of[number])
        order = np.argsort(cost, kind="stable")
        level = (m + np.cumsum((cost / rise)[order])) / np.cumsum((1 / rise)[order])
        deep = np.flatnonzero(level > cost[order])[-1]
        taken = np.floor(np.maximum(0, (level[deep] - cost) / rise) + 1e-9).astype(int)
        for _ in range(m - int(taken.sum())):
            taken[int((cost + rise * taken).argmin())] += 1
        held += np.outer(taken, add)
        ends = np.cumsum(taken).tolist()
        plan += [(number, stop - n + 1, stop + 1, s) for n, stop, s in zip(taken.tolist(), ends, names) if n]
    spark = members.sparkSession
    numbers = spark.createDataFrame([(k, r["kind"]) for k, r in enumerate(table)], f"number int, kind {kinds.schema['kind'].dataType.simpleString()}")
    blocks = spark.createDataFrame(plan, "number int, start long, stop long, split string")
    dealt = kinds.join(numbers, "kind").join(blocks, "number").where("place >= start and place < stop").select(family, "split")
    return lookup(members, family, key, dealt).where("split is not null").select(key, "split")
