"""Ranks, utilities, quota takes, samples, ECDFs, votes and scenario regret."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import materialize

MOST_SETTINGS = 10_000
#: Bits that monotonically_increasing_id gives to a row's place in its partition.
PLACE = 33


def value_ranks(df: DataFrame, column: str, slices: int = 64) -> DataFrame:
    """``(column, percentile)`` per distinct value: (average rank - 0.5) / n.

    Values are counted first, then prefix-summed in two levels: inside range slices (one window per slice), and over
    the slices' totals (at most ``slices`` rows). No window runs over all rows.
    """
    counts = df.groupBy(column).agg(F.count("*").alias("cnt"))
    return _prefix(counts, column, slices).select(column, ((F.col("before") + (F.col("cnt") + 1) / 2 - 0.5) / F.col("total")).alias("percentile"))


def _place(df: DataFrame, column: str) -> Column:
    """A number that rises with the column, to cut it in ranges: for strings, their first six bytes."""
    if df.schema[column].dataType.simpleString() not in ("string", "binary"):
        return F.col(column)
    return F.conv(F.rpad(F.hex(F.substring(F.col(column).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")


def _sliced_prefix(counts: DataFrame, group: str, column: str, slices: int) -> DataFrame:
    """``counts (group, column, cnt)`` with ``before`` (rows of smaller values in the group) and ``total`` (rows of the group).

    The borders of the slices are approximate percentiles of the distinct values; they only deal the work and don't
    touch the result. The slices' totals are at most ``slices`` rows a group.
    """
    place = _place(counts, column)
    borders = counts.groupBy(group).agg(F.percentile_approx(place, [k / slices for k in range(1, slices)], 1000).alias("_b"))
    sliced = counts.join(F.broadcast(borders), group).withColumn("_slice", F.size(F.filter(F.array_distinct("_b"), lambda b: b < place))).drop("_b")
    totals = sliced.groupBy(group, "_slice").agg(F.sum("cnt").alias("t"))
    whole = Window.partitionBy(group)
    sums = totals.select(group, "_slice", F.coalesce(F.sum("t").over(whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("t").over(whole).alias("total"))
    inside = F.coalesce(F.sum("cnt").over(Window.partitionBy(group, "_slice").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sliced.withColumn("_inside", inside).join(F.broadcast(sums), [group, "_slice"]).withColumn("before", F.col("_base") + F.col("_inside")).drop("_slice", "_inside", "_base")


def _prefix(counts: DataFrame, column: str, slices: int) -> DataFrame:
    """``counts (column, cnt)`` with ``before`` (rows of smaller values) and ``total``."""
    return _sliced_prefix(counts.withColumn("_g", F.lit(0)), "_g", column, slices).drop("_g")


def running(df: DataFrame, column: str, sums: Sequence[str], slices: int = 64) -> DataFrame:
    """``df`` (one row per value of ``column``) with ``x_upto`` and ``x_total`` for each x of ``sums``, and ``next``: the next value.

    Two levels, as above: windows inside slices of the values, then over at most ``slices`` rows of totals.
    """
    place = _place(df, column)
    borders = df.agg(F.percentile_approx(place, [k / slices for k in range(1, slices)], 1000).alias("_b"))
    sliced = df.crossJoin(F.broadcast(borders)).withColumn("_slice", F.size(F.filter(F.array_distinct("_b"), lambda b: b < place))).drop("_b")  # one row
    own = Window.partitionBy("_slice").orderBy(column)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    inside = sliced.withColumns({f"_{x}": F.sum(x).over(upto) for x in sums} | {"_next": F.lead(column).over(own)})
    totals = sliced.groupBy("_slice").agg(F.min(column).alias("_first"), *(F.sum(x).alias(f"_t{x}") for x in sums))
    order = Window.orderBy("_slice")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = totals.select("_slice", F.lead("_first").over(order).alias("_after"), *(F.coalesce(F.sum(f"_t{x}").over(before), F.lit(0)).alias(f"_b{x}") for x in sums), *(F.sum(f"_t{x}").over(every).alias(f"{x}_total") for x in sums))
    out = inside.join(F.broadcast(base), "_slice").withColumns({f"{x}_upto": F.col(f"_b{x}") + F.col(f"_{x}") for x in sums} | {"next": F.coalesce("_next", "_after")})
    return out.drop("_slice", "_next", "_after", "_first", *(f"_{k}{x}" for k in ("", "b", "t") for x in sums))


def percentile_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the average-tie percentile of ``column`` in ``df``; NaN or null is an error."""
    checked = F.when(F.col(column).isNull() | F.isnan(F.col(column).cast("double")), F.raise_error(F.lit(f"nonfinite {column}"))).otherwise(F.col(column))
    ranks = value_ranks(df, column).withColumnRenamed("percentile", out)
    return df.withColumn(column, checked).join(ranks, column)


def weighted_utility(df: DataFrame, prob: str, mic: str, known: str, weights: tuple[float, float, float] = (0.55, 0.45, -0.05)) -> DataFrame:
    """``df`` with ``utility``: weighted percentiles of -log2(mic), prob and known similarity, relative to the rows of ``df``.

    The ranks of all three columns come from one table of counts ``(measure, value)``, so ``df`` is read twice in all.
    """
    measures = {"a": -F.log2(mic), "p": F.col(prob).cast("double"), "k": F.col(known).cast("double")}
    bad = sum(((v.isNull() | F.isnan(v)).cast("int") for v in measures.values()), F.lit(0)) > 0
    df = df.withColumn("_m", F.when(bad, F.raise_error(F.lit("nonfinite utility"))).otherwise(F.struct(*(v.alias(k) for k, v in measures.items()))))
    long = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), F.col(f"_m.{k}").alias("value")) for k in measures))).alias("x")).select("x.*")
    counts = long.groupBy("measure", "value").agg(F.count("*").alias("cnt"))
    ranks = _sliced_prefix(counts, "measure", "value", 64).select("measure", "value", ((F.col("before") + (F.col("cnt") + 1) / 2 - 0.5) / F.col("total")).alias("r"))
    for k in measures:
        df = df.join(ranks.where(F.col("measure") == k).select(F.col("value").alias(f"_v{k}"), F.col("r").alias(f"_{k}")), F.col(f"_m.{k}") == F.col(f"_v{k}"))
    a, p, k = weights
    return df.withColumn("utility", a * F.col("_a") + p * F.col("_p") + k * F.col("_k")).drop("_m", *(f"_{x}{y}" for x in ("", "v") for y in measures))


def take_quota(df: DataFrame, group: str, quota: str, order: Sequence[Column]) -> DataFrame:
    """The first ``quota`` rows of each group."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_place") <= F.col(quota)).drop("_place")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash of the key: the same rows on any cluster."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def hash_halves(df: DataFrame, key: str, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    half = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2))
    return df.where(half == 0), df.where(half == 1)


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """``df`` with ``out``: its rows' numbers from 0 in the order of the key (of equal keys in any order; nulls are one key, the least).

    One shuffle by ranges of the key (a key of many rows is cut by a hash of the row), written with each row's partition and
    place; the partitions' counts, a row each, give where they start. So the numbers do not depend on how a plan deals the rows.
    """
    mixed = F.xxhash64(*df.columns)
    sorted_ = df.repartitionByRange(F.col(key), mixed).sortWithinPartitions(F.col(key), mixed)
    # The id's upper bits are the partition, the lower PLACE ones the place in it.
    placed = materialize(sorted_.withColumn("_place_at", F.monotonically_increasing_id()), "placed").withColumn("_place_part", F.shiftright("_place_at", PLACE))
    before = Window.orderBy("_place_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_place_part").agg(F.count("*").alias("_place_n"))
    starts = counts.select("_place_part", F.coalesce(F.sum("_place_n").over(before), F.lit(0)).alias("_place_start"))
    rows = placed.join(F.broadcast(starts), "_place_part")
    return rows.withColumn(out, (F.col("_place_start") + F.col("_place_at").bitwiseAND(F.lit((1 << PLACE) - 1))).cast("long")).drop("_place_at", "_place_part", "_place_start")


def hash_sample_with_replacement(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``(draw, ...)``: n draws of rows, each by a hash of its number; rows are numbered by a total order on the key."""
    total = df.count()
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, total))).alias("_row"))
    return draws.join(numbered(df, key, "_row"), "_row").drop("_row")


def first_occurrences(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in the order of their first rows."""
    return df.groupBy(key).agg(F.min(order).alias(order)).orderBy(order)


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """``df`` with ``batch``, numbering rows in runs of ``size`` by the key."""
    return numbered(df, key, "_row").withColumn("batch", F.floor(F.col("_row") / size)).drop("_row")


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """``(column, p)`` at each distinct value."""
    ranks = _prefix(df.groupBy(column).agg(F.count("*").alias("cnt")), column, 64)
    return ranks.select(column, ((F.col("before") + F.col("cnt")) / F.col("total")).alias("p"))


def model_votes(scores: DataFrame, penalty: float = 0.25) -> DataFrame:
    """``(seq, vote)`` from long scores ``(seq, model, family, kind, value)``.

    A model's percentile per row (of -log2 of a concentration, else of the value) is averaged in its family; a row's
    vote is the mean over families minus ``penalty`` population deviations, clipped to [0, 1]. A value that is null or not
    finite, and a row that lacks a model, are errors: all cells must be there.
    """
    better = F.when(F.col("kind") == "mic_um", -F.log2("value")).otherwise(F.col("value")).cast("double")
    bad = better.isNull() | F.isnan(better) | (F.abs(better) == float("inf"))
    values = scores.withColumn("v", F.when(bad, F.raise_error(F.concat(F.lit("nonfinite score of model "), F.col("model")))).otherwise(better))
    per_value = values.groupBy("model", "v").agg(F.count("*").alias("cnt"))
    ranks = _sliced_prefix(per_value, "model", "v", 64).select("model", "v", ((F.col("before") + (F.col("cnt") + 1) / 2 - 0.5) / F.col("total")).alias("r"))
    models = F.broadcast(scores.agg(F.count_distinct("model").alias("_models")))  # one row
    # One shuffle of rows by seq: a family's mean over its models, then the vote over the families.
    family = values.join(ranks, ["model", "v"]).groupBy("seq", "family").agg(F.avg("r").alias("f"), F.count_distinct("model").alias("m"))
    vote = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("f") - penalty * F.stddev_pop("f")))
    out = family.groupBy("seq").agg(vote.alias("vote"), F.sum("m").alias("_m")).crossJoin(models)
    missing = F.raise_error(F.concat(F.lit("scores of some models are missing for "), F.col("seq").cast("string")))
    return out.select("seq", F.when(F.col("_m") < F.col("_models"), missing).otherwise(F.col("vote")).alias("vote"))


def weight_grid(n: int, levels: Sequence[int] = (1, 2, 3, 4), heavy: float = 0.7) -> list[tuple[float, ...]]:
    """Scenario weights: all compositions of tenths in ``levels`` with sum one, the equal one, and one per metric in which it is heavy."""
    grid = [tuple(x / 10 for x in c) for c in itertools.product(levels, repeat=n) if sum(c) == 10]
    grid.append((1 / n,) * n)
    grid += [tuple(heavy if i == j else (1 - heavy) / (n - 1) for i in range(n)) for j in range(n)]
    return grid


def minimax_regret(settings: DataFrame, key: str, metrics: Sequence[str], weights: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """``(key, regret, pareto)``: the largest loss over weight scenarios against each one's best setting (metrics: higher is better), and whether no setting is better throughout.

    The scenarios are a small stated set; each row is scored against all of them in place.
    """
    weights = list(weights or weight_grid(len(metrics)))
    # Settings are runs of an experiment, a table for people: dominance is tested for all pairs of them.
    if settings.count() > MOST_SETTINGS:
        raise ValueError(f"more than {MOST_SETTINGS} settings")
    score = F.array(*(sum((F.col(m) * F.lit(float(x)) for m, x in zip(metrics, w)), F.lit(0.0)) for w in weights))
    scored = settings.select(key, *metrics).select(key, *metrics, score.alias("scores"))
    best = scored.select(*(F.max(F.col("scores")[k]).alias(f"b{k}") for k in range(len(weights)))).first()
    tops = [best[f"b{k}"] or 0.0 for k in range(len(weights))]
    regret = F.array_max(F.array(*(F.lit(float(t)) - F.col("scores")[k] for k, t in enumerate(tops))))
    a, b = scored.alias("a"), scored.distinct().alias("b")
    no_worse = sum(((F.col(f"b.{m}") >= F.col(f"a.{m}")).cast("int") for m in metrics), F.lit(0)) == len(metrics)
    some_better = sum(((F.col(f"b.{m}") > F.col(f"a.{m}")).cast("int") for m in metrics), F.lit(0)) > 0
    beaten = a.join(b, no_worse & some_better, "left_semi").select(F.col(f"a.{key}").alias(key), F.lit(False).alias("p"))
    return scored.select(key, regret.alias("regret")).join(beaten, key, "left").select(key, "regret", F.coalesce("p", F.lit(True)).alias("pareto"))
