"""Fuzzy joins by normalised Indel similarity: best match, neighbours, edges, families, greedy clusters.

Both sides are cut into chunks of similar lengths, and a unit of work is a pair of chunks: each row names its
units and is sent there by a shuffle, never by a cross join. In joins of a table with itself each pair of chunks
meets once. A unit runs each string over all that it may match at once, a step a letter, and strings with a common beginning share its
steps (some nanoseconds a pair); lengths that allow too little, or less than the best found so far, are left out.

An index of segments was measured and left out: a pair at 80 % has up to 0.4 edits a letter, so the segments of which one
must survive have two or three letters, and on the driver's sequences 47 % of the pairs of fitting lengths share one at a
near place, against 3 % that share enough letters (boxes of letter counts around 2048 strings: 60 %).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lcs import WORD, Strings, best_of, bests_of_both, near_pairs
from .tables import components, discard, in_units, lookup, materialize, whole_units

#: Strings of a chunk (fewer of a small table, but so many), letters of a reference that may go to every task as a whole, and units a search for bests has at least.
CHUNK, LEAST_CHUNK = 1 << 14, 256
SMALL_LETTERS, UNITS = 1 << 16, 36


def _column(part: pa.RecordBatch | pa.Table, name: str) -> list:
    return part.column(part.schema.get_field_index(name)).to_pylist()


def _chunked(df: DataFrame, key: str, chunk: int, parts: int = 12, banded: bool = True, even: bool = False) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """``(seq, band, at)``, and the bands: least and greatest length, and number of chunks.

    A band is a run of lengths with about a chunk of strings, or one length with more; the driver gets one count per
    length. Chunks are smaller where strings are few, so that there is work for all tasks (``parts`` of them).
    Not ``banded``: one band, each chunk has strings of all lengths, as a search for bests needs them to leave lengths out.
    ``even``: a chunk has at most the letters of a chunk of mean strings, where work goes with letters and not with strings.
    """
    seqs = df.select(F.col(key).alias("seq")).where(F.col("seq").isNotNull()).distinct().withColumn("len", F.length("seq"))
    seqs = materialize(seqs, "distinct")  # counted and dealt: made once
    counts = sorted((r["len"], r["n"]) for r in seqs.groupBy("len").agg(F.count("*").alias("n")).collect())
    chunk = max(1, min(chunk, max(LEAST_CHUNK, -(-sum(n for _, n in counts) // parts))))
    most = max(1, chunk * sum(size * n for size, n in counts) // max(1, sum(n for _, n in counts)))
    bands: list[list[int]] = []
    for size, n in counts:
        if bands and (not banded or bands[-1][2] + n <= chunk):
            bands[-1][1:] = size, bands[-1][2] + n, bands[-1][3] + size * n
        else:
            bands.append([size, size, n, size * n])
    sizes = [(low, high, min(n, max(-(-n // chunk), -(-letters // most) if even else 1))) for low, high, n, letters in bands]
    borders = F.array(*(F.lit(low) for low, _, _ in sizes)) if sizes else F.array(F.lit(0))
    seqs = seqs.withColumn("band", F.size(F.filter(borders, lambda x: x <= F.col("len"))) - 1)
    number = F.array(*(F.lit(n) for _, _, n in sizes)) if sizes else F.array(F.lit(1))
    return seqs.select("seq", "band", F.pmod(F.xxhash64("seq"), F.element_at(number, F.col("band") + 1)).cast("int").alias("at")), sizes


def _partners(own: list[tuple[int, int, int]], sizes: list[tuple[int, int, int]], percent: int | None) -> Column:
    """The chunks ``(band, at)`` that the chunk in columns ``band`` (of ``own``) and ``at`` meets: those whose lengths allow a similarity of ``percent``."""

    def fits(x: tuple[int, int, int], y: tuple[int, int, int]) -> bool:
        x, y = sorted((x, y))
        return percent is None or y[0] <= x[1] or 200 * x[1] >= percent * (x[1] + y[0])

    known = F.array(*(F.array(*(F.struct(F.lit(k).alias("band"), F.lit(y[2]).alias("chunks")) for k, y in enumerate(sizes) if fits(x, y))).cast("array<struct<band: int, chunks: int>>") for x in own))
    return F.flatten(F.transform(F.element_at(known, F.col("band") + 1), lambda x: F.transform(F.sequence(F.lit(0), x["chunks"] - 1), lambda k: F.struct(x["band"].alias("band"), k.alias("at")))))


def _units(left: DataFrame, ls: list[tuple[int, int, int]], right: DataFrame, rs: list[tuple[int, int, int]], percent: int | None) -> DataFrame:
    """Rows ``(unit, side, seq)`` for all pairs of chunks whose lengths allow a similarity of ``percent``. Each row names its units itself."""
    if not ls or not rs:
        return left.select(F.lit(0).cast("long").alias("unit"), F.lit(0).alias("side"), "seq").limit(0)
    lu = left.withColumn("y", F.explode(_partners(ls, rs, percent))).select(F.xxhash64("band", "at", "y.band", "y.at").alias("unit"), F.lit(0).alias("side"), "seq")
    ru = right.withColumn("y", F.explode(_partners(rs, ls, percent))).select(F.xxhash64("y.band", "y.at", "band", "at").alias("unit"), F.lit(1).alias("side"), "seq")
    return lu.union(ru)


def _self_units(rows: DataFrame, sizes: list[tuple[int, int, int]], percent: int | None) -> DataFrame:
    """Rows ``(unit, side, seq)`` for all pairs of chunks of one table, each pair once; the unit of a chunk with itself has side 0 only."""
    if not sizes:
        return rows.select(F.lit(0).cast("long").alias("unit"), F.lit(0).alias("side"), "seq").limit(0)
    met = rows.withColumn("y", F.explode(_partners(sizes, sizes, percent)))
    later = (F.col("y.band") > F.col("band")) | ((F.col("y.band") == F.col("band")) & (F.col("y.at") >= F.col("at")))
    unit = F.when(later, F.xxhash64("band", "at", "y.band", "y.at")).otherwise(F.xxhash64("y.band", "y.at", "band", "at"))
    return met.select(unit.alias("unit"), F.when(later, 0).otherwise(1).alias("side"), "seq")


def _count(ls: list[tuple[int, int, int]], rs: list[tuple[int, int, int]] | None = None) -> int:
    """How many units there are at most."""
    n, m = sum(x[2] for x in ls), sum(x[2] for x in rs or ls)
    return n * m if rs is not None else n * (n + 1) // 2


def _each_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str]]]:
    """The two sides of each unit."""
    for table in whole_units(batches):
        unit, side, seqs = np.array(_column(table, "unit")), np.array(_column(table, "side")), np.array(_column(table, "seq"), dtype=object)
        for u in np.unique(unit):
            yield seqs[(unit == u) & (side == 0)].tolist(), seqs[(unit == u) & (side == 1)].tolist()


def _passing(a: list[str], b: list[str] | None, percent: int, strict: bool) -> pa.RecordBatch:
    """``(a, b, lcs)`` of the pairs at the threshold; without ``b`` those inside ``a``, each once."""
    i, j, n = near_pairs(Strings(a), None if b is None else Strings(b), percent, strict)
    left, right = pa.array(a, pa.string()), pa.array(a if b is None else b, pa.string())
    return pa.RecordBatch.from_arrays([left.take(pa.array(i)), right.take(pa.array(j)), pa.array(n, pa.int32())], names=["a", "b", "lcs"])


def pairs_at_least(left: DataFrame, right: DataFrame, percent: int = 80, strict: bool = False, left_key: str = "seq", right_key: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """``(a, b, lcs)``: all pairs of distinct strings with a similarity of at least ``percent`` (``strict``: above it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _each_unit(batches):
            yield _passing(a, b, percent, strict)

    lu, ls = _chunked(left, left_key, chunk)
    ru, rs = _chunked(right, right_key, chunk)
    return in_units(_units(lu, ls, ru, rs, percent), run, "a string, b string, lcs int", _count(ls, rs))


def similarity_edges(df: DataFrame, percent: int = 80, strict: bool = False, key: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """``(a, b, lcs)`` with a < b: the pairs of distinct strings of ``df`` at the threshold. Each pair meets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _each_unit(batches):
            yield _passing(a, b or None, percent, strict)

    rows, sizes = _chunked(df, key, chunk)
    found = in_units(_self_units(rows, sizes, percent), run, "a string, b string, lcs int", _count(sizes))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "lcs")


def max_similarity(left: DataFrame, reference: DataFrame, key: str = "seq", reference_key: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """``(seq, best_lcs, best_total, best)`` per distinct string: its most similar string of the reference (greatest ratio, then least string).

    The ratio is 2 best_lcs / best_total. An empty reference is an error.
    """
    ref = materialize(reference.select(F.col(reference_key).alias("seq")).where(F.col("seq").isNotNull()).distinct(), "reference")
    size = ref.agg(F.sum(F.length("seq") + 8).alias("n")).first()["n"]
    if not size:
        raise ValueError("empty similarity reference")
    schema = "seq string, best_lcs int, best_total int, best string"

    def best_rows(left: list[str], b: Strings) -> pa.RecordBatch:
        at, n, total, _ = best_of(Strings(left), b)
        return pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(n, pa.int32()), pa.array(total, pa.int32()), pa.array(b.strings, pa.string()).take(pa.array(at))], names=["seq", "best_lcs", "best_total", "best"])

    if size <= SMALL_LETTERS:
        lu, ls = _chunked(left, key, chunk, UNITS)
        known = sorted(r["seq"] for r in ref.collect())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = Strings(known)
            for table in whole_units(batches):
                yield best_rows(_column(table, "seq"), b)

        return in_units(lu.select(F.xxhash64("band", "at").alias("unit"), "seq"), run, schema, _count(ls, [(0, 0, 1)]))

    def run_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _each_unit(batches):
            if a and b:
                yield best_rows(a, Strings(sorted(b)))

    # A step costs its call and a little per string it moves on, so the left side stays in whole chunks and the reference gives the tasks.
    lu, ls = _chunked(left, key, chunk, 1)
    ru, rs = _chunked(ref, "seq", 2 * chunk, -(-UNITS // max(1, sum(x[2] for x in ls))), False)
    parts = in_units(_units(lu, ls, ru, rs, None), run_units, schema, _count(ls, rs))
    # One pass: the greatest ratio, and of equal ones the least string, as the least of (-ratio, string).
    rank = F.struct((-F.col("best_lcs") / F.col("best_total")).alias("r"), "best", "best_lcs", "best_total")
    return parts.groupBy("seq").agg(F.min(rank).alias("m")).select("seq", "m.best_lcs", "m.best_total", "m.best")


def neighbor_counts(df: DataFrame, percent: int = 80, key: str = "seq") -> DataFrame:
    """``(seq, neighbors)`` of each distinct string: how many others are above the threshold."""
    edges = similarity_edges(df, percent, True, key)
    ends = edges.select(F.explode(F.array("a", "b")).alias("seq"))  # one pass: a union would find the pairs twice
    counts = ends.groupBy("seq").agg(F.count("*").alias("n"))
    seqs = df.select(F.col(key).alias("seq")).where(F.col("seq").isNotNull()).distinct()
    return seqs.join(counts, "seq", "left").select("seq", F.coalesce("n", F.lit(0)).cast("long").alias("neighbors"))


def neighbor_bests(df: DataFrame, percent: int = 80, key: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """``(seq, neighbors, best_lcs, best_total)``: how many others are above the threshold, and the best match among the others (0 of 1 for a lone string).

    Each pair of chunks meets once and serves both sides, and so does each pair of strings that fit a word.
    """

    def one_side(a: Strings, b: Strings, own: bool = False) -> pa.RecordBatch:
        at, n, total, near = best_of(a, b, percent, own)
        some = np.flatnonzero(at >= 0)
        return pa.RecordBatch.from_arrays([pa.array(a.strings, pa.string()).take(pa.array(some)), *(pa.array(x[some], pa.int32()) for x in (near, n, total))], names=["seq", "near", "best_lcs", "best_total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for left, right in _each_unit(batches):
            a, b = Strings(sorted(left)), Strings(sorted(right))
            if not right:
                yield one_side(a, a, True)
            elif left and max(a.size.max(), b.size.max()) <= WORD:
                for side, (n, total, near) in zip((a, b), bests_of_both(a, b, percent)):
                    yield pa.RecordBatch.from_arrays([pa.array(side.strings, pa.string()), *(pa.array(x, pa.int32()) for x in (near, n, total))], names=["seq", "near", "best_lcs", "best_total"])
            elif left:
                yield one_side(a, b)
                yield one_side(b, a)

    rows, sizes = _chunked(df, key, chunk)
    parts = in_units(_self_units(rows, sizes, None), run, "seq string, near int, best_lcs int, best_total int", _count(sizes))
    top = parts.groupBy("seq").agg(F.sum("near").alias("neighbors"), F.max(F.struct((F.col("best_lcs") / F.col("best_total")).alias("r"), "best_lcs", "best_total")).alias("m"))
    out = rows.select("seq").join(top, "seq", "left")
    return out.select("seq", F.coalesce("neighbors", F.lit(0)).cast("long").alias("neighbors"), F.coalesce("m.best_lcs", F.lit(0)).alias("best_lcs"), F.coalesce("m.best_total", F.lit(1)).alias("best_total"))


def neighbor_report(df: DataFrame, percent: int = 80, key: str = "seq") -> DataFrame:
    """One row of neighbourhood statistics over the distinct strings."""
    rows = neighbor_bests(df, percent, key).withColumn("best", 2 * F.col("best_lcs") / F.col("best_total"))
    return rows.agg(
        F.count("*").alias("n"),
        F.avg((F.col("neighbors") > 0).cast("int")).alias("near_neighbor_fraction"),
        F.avg("neighbors").alias("mean_neighbors"),
        F.percentile("best", F.lit(0.5)).alias("max_similarity_median"),
        F.percentile(1 - F.col("best"), F.lit(0.5)).alias("nearest_distance_median"),
        F.percentile(1 - F.col("best"), F.lit(0.1)).alias("nearest_distance_q10"),
        F.floor(F.sum("neighbors") / 2).cast("long").alias("undirected_edges"),
    )


def families(df: DataFrame, percent: int = 80, key: str = "seq") -> DataFrame:
    """``(seq, family)``: connected components of the pairs at the threshold; a family is named by its least string."""
    seqs = df.select(F.col(key).alias("seq")).where(F.col("seq").isNotNull()).distinct()
    found = components(materialize(similarity_edges(df, percent, False, key).select("a", "b"), "edges"))
    return seqs.join(found.withColumnRenamed("node", "seq"), "seq", "left").select("seq", F.coalesce("component", "seq").alias("family"))


def crowding(df: DataFrame, sample: DataFrame, percent: int = 80, key: str = "seq") -> DataFrame:
    """``(seq, crowding)``: the share of the sample (without the string itself) above the threshold."""
    inside = sample.select(F.col(key).alias("seq")).distinct()
    size = inside.count()
    near = pairs_at_least(df, inside, percent, True, key, "seq").where("a <> b").groupBy(F.col("a").alias("seq")).agg(F.count("*").alias("n"))
    seqs = df.select(F.col(key).alias("seq")).distinct().join(inside.withColumn("own", F.lit(1)), "seq", "left").join(near, "seq", "left")
    others = F.greatest(F.lit(1), F.lit(size) - F.coalesce("own", F.lit(0)))
    return seqs.select("seq", (F.coalesce("n", F.lit(0)) / others).alias("crowding"))


#: Edges that one task may settle in order.
FINISH = 200_000


def _fallen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names that have an earlier representative beside them, of edges ``(a, b)`` with a < b in the order of b."""
    fallen, kind = set(), pa.string()
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(_column(batch, "a"), _column(batch, "b")):
            if a not in fallen:
                fallen.add(b)
    yield pa.RecordBatch.from_arrays([pa.array(sorted(fallen), kind)], names=["seq"])


def followers(edges: DataFrame) -> DataFrame:
    """``(seq)``: the names (strings or numbers) that are no representatives, where one is if none before it that it has an edge with is one.

    In rounds of joins, whatever the size of a family: a string without undecided strings before it is a representative,
    and those after it that are similar to it fall. Edges of decided strings go; once at most FINISH are left, one task ends it.
    """
    live, parts = materialize(edges.select("a", "b").where("a < b").distinct(), "live"), []
    while n := live.count():
        if n <= FINISH:
            parts.append(materialize(live.repartition(1).sortWithinPartitions("b", "a").mapInArrow(_fallen, f"seq {edges.schema['a'].dataType.simpleString()}"), "fallen"))
            break
        heads = live.select("a").distinct().join(live.select(F.col("b").alias("a")).distinct(), "a", "left_anti").withColumn("head", F.lit(True))
        down = materialize(lookup(live, "a", "b", heads).where("head").select(F.col("b").alias("seq")).distinct(), "fallen")
        rest = lookup(live, "b", "a", down.select(F.col("seq").alias("b"), F.lit(True).alias("b_fell"))).where("b_fell IS NULL").select("a", "b")
        rest = lookup(rest, "a", "b", down.select(F.col("seq").alias("a"), F.lit(True).alias("a_fell"))).where("a_fell IS NULL").select("a", "b")
        rest = materialize(rest, "live")
        discard(live)
        live = rest
        parts.append(down)
    out = parts[0] if parts else edges.select(F.col("a").alias("seq")).limit(0)
    for p in parts[1:]:
        out = out.union(p)
    return out


def greedy_clusters(df: DataFrame, percent: int = 80, key: str = "seq") -> DataFrame:
    """``(seq, representative)``: strings in order join the most similar earlier representative at the threshold, else become one.

    Of equal representatives the earliest counts. All on the table of similar pairs: no family is one task.
    """
    seqs = df.select(F.col(key).alias("seq")).where(F.col("seq").isNotNull()).distinct()
    edges = materialize(similarity_edges(df, percent, False, key), "edges")
    fell = materialize(followers(edges).withColumn("fell", F.lit(True)), "followers")
    near = lookup(edges, "a", "b", fell.select(F.col("seq").alias("a"), "fell")).where("fell IS NULL")
    rank = F.struct((-F.col("lcs") / (F.length("a") + F.length("b"))).alias("r"), F.col("a").alias("representative"))
    chosen = near.groupBy(F.col("b").alias("seq")).agg(F.min(rank)["representative"].alias("representative"))
    return seqs.join(chosen, "seq", "left").select("seq", F.coalesce("representative", "seq").alias("representative"))


def exclusive(ranked: DataFrame, order: tuple, percent: int = 80, key: str = "seq") -> DataFrame:
    """``(at, seq)``: the distinct strings that are taken when they are asked for in ``order`` and none that is above the threshold to a taken one is; ``at`` rises with the order.

    Strings are numbered by one sort, similar pairs found by the fuzzy join, and taken in rounds of joins: nothing passes the driver.
    """
    rows = ranked.orderBy(*order).select(F.col(key).alias("seq")).withColumn("at", F.monotonically_increasing_id())
    rows = materialize(materialize(rows, "sorted").groupBy("seq").agg(F.min("at").alias("at")), "ranked")
    edges = similarity_edges(rows, percent, True)
    for end in ("a", "b"):
        edges = lookup(edges, end, "b" if end == "a" else "a", rows.select(F.col("seq").alias(end), F.col("at").alias(f"at_{end}")))
    edges = edges.select(F.least("at_a", "at_b").alias("a"), F.greatest("at_a", "at_b").alias("b"))
    return rows.join(followers(edges).withColumnRenamed("seq", "at"), "at", "left_anti").select("at", "seq")


def top_exclusive(ranked: DataFrame, k: int, percent: int = 80, order: tuple = (), key: str = "seq") -> list[str]:
    """The first k strings in ``order`` of which no two are above the threshold; an error if there are fewer. The driver gets those k."""
    chosen = [r["seq"] for r in exclusive(ranked, order, percent, key).orderBy("at").limit(k).collect()]
    if len(chosen) < k:
        raise ValueError(f"only {len(chosen)} of {k} mutually dissimilar strings")
    return chosen
