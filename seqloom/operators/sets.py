"""Exact joins and set algebra between collections, and alignment summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.residues import coverage_gate, identity_gate
from .tables import materialize


def exclude(left: DataFrame, right: DataFrame, key: str = "seq") -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_anti")


def overlap(left: DataFrame, right: DataFrame, key: str = "seq") -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_semi")


def known_union(*collections: DataFrame, key: str = "seq") -> DataFrame:
    out = collections[0].select(key)
    for c in collections[1:]:
        out = out.unionByName(c.select(key))
    return out.distinct()


def remove_conflicts(negatives: DataFrame, positives: DataFrame, key: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(negatives that are no positives, the conflicts)."""
    return exclude(negatives, positives, key), overlap(negatives.select(key).distinct(), positives, key)


def is_subset(left: DataFrame, right: DataFrame, key: str = "seq") -> bool:
    return exclude(left, right, key).isEmpty()


def equal_sets(left: DataFrame, right: DataFrame, key: str = "seq") -> bool:
    return is_subset(left, right, key) and is_subset(right, left, key)


def exact_matches(queries: DataFrame, reference: DataFrame, key: str = "seq", ident: str = "id", header: str = "header") -> DataFrame:
    """Queries that are in the reference, with all ids and headers of their duplicate group, in order."""
    groups = reference.join(queries.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(ident, header))).alias("g"))
    return queries.join(groups, key).select(*queries.columns, F.col(f"g.{ident}").alias("ids"), F.col(f"g.{header}").alias("headers"))


def merge_tables(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer merge of two predictor tables; a key in only one, or a column in both, is an error."""
    shared = (set(left.columns) & set(right.columns)) - {key}
    if shared:
        raise ValueError(f"columns in both tables: {sorted(shared)}")
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), key, "full_outer")
    one_sided = F.col("_l").isNull() | F.col("_r").isNull()
    return both.withColumn(key, F.when(one_sided, F.raise_error(F.concat(F.lit("key in one table only: "), F.col(key).cast("string")))).otherwise(F.col(key))).drop("_l", "_r")


def join_scores(candidates: DataFrame, scores: DataFrame, key: str = "seq", required: bool = True) -> DataFrame:
    """Scores of the candidates; where they are required, a missing or non-finite cell is an error."""
    out = candidates.join(scores, key, "left" if required else "inner")
    if required:
        for c in scores.columns:
            if c != key:
                bad = F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
                out = out.withColumn(c, F.when(bad, F.raise_error(F.concat(F.lit(f"no {c} for "), F.col(key)))).otherwise(F.col(c)))
    return out


def accumulate(pool: DataFrame, streams: list[DataFrame], target: int, key: str = "seq", known: DataFrame | None = None) -> tuple[DataFrame, list[int]]:
    """Add streams to a pool of distinct keys, without known ones, until it has ``target`` rows: (pool, rows added by each stream read)."""
    pool = pool.select(key).distinct()
    pool = exclude(pool, known, key) if known is not None else pool
    added, n = [], pool.count()
    for s in streams:
        if n >= target:
            break
        fresh = exclude(s.select(key).distinct(), pool, key)
        # Written once: each later stream reads the keys, not the plans of all streams before it.
        fresh = materialize(exclude(fresh, known, key) if known is not None else fresh, "fresh")
        added.append(fresh.count())
        n += added[-1]
        pool = pool.union(fresh)
    return pool, added


def alignment_columns(df: DataFrame) -> DataFrame:
    """13-column alignment rows with identity and coverages; ``valid`` is false where coordinates or counts contradict each other."""
    span = lambda a, b: F.col(b) - F.col(a) + 1
    valid = (
        (F.col("alnlen") > 0) & (F.col("nident") >= 0) & (F.col("nident") <= F.col("alnlen")) & (F.col("bits") >= 0)
        & (F.col("qstart") >= 1) & (F.col("qend") >= F.col("qstart")) & (F.col("qend") <= F.col("qlen"))
        & (F.col("tstart") >= 1) & (F.col("tend") >= F.col("tstart")) & (F.col("tend") <= F.col("tlen"))
    )
    return (
        df.withColumn("valid", F.coalesce(valid, F.lit(False)))
        .withColumn("identity", F.when(F.col("alnlen") > 0, F.col("nident") / F.col("alnlen")))
        .withColumn("query_coverage", span("qstart", "qend") / F.col("qlen"))
        .withColumn("target_coverage", span("tstart", "tend") / F.col("tlen"))
    )


def alignment_summary(rows: DataFrame) -> DataFrame:
    """Per query: rows, rows above 80 % identity, those that also cover 80 % of the query, and the best rows by bits and by identity.

    Counts and arg-best merge, so the aggregate has a partial and a final step like any built-in one.
    """
    high = identity_gate(F.col("nident"), F.col("alnlen"))
    full = coverage_gate(F.col("qend") - F.col("qstart") + 1, F.col("qlen"))
    rank: Column = F.struct("bits", "raw", "identity", "target")
    by_identity: Column = F.struct("identity", "query_coverage", "bits", "target")
    return rows.groupBy("query").agg(
        F.count("*").alias("rows"),
        F.count_if(high).alias("high_identity"),
        F.count_if(high & full).alias("high_identity_covered"),
        F.max(rank).alias("best"),
        F.max(by_identity).alias("closest"),
    )


def best_bits(rows: DataFrame, self_rows: DataFrame) -> DataFrame:
    """``(query, similarity, novelty)``: best bits against others over the query's own, in [0, 1]; a query without its own score is an error."""
    own = self_rows.groupBy("query").agg(F.max("bits").alias("own"))
    top = rows.groupBy("query").agg(F.max("bits").alias("top"))
    joined = top.join(own, "query", "full_outer").withColumn("own", F.when(F.col("own").isNull(), F.raise_error(F.concat(F.lit("no own score: "), F.col("query").cast("string")))).otherwise(F.col("own")))
    sim = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("top", F.lit(0.0)) / F.col("own")))
    return joined.select("query", sim.alias("similarity"), (1 - sim).alias("novelty"))
