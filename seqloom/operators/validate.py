"""Validators that collect every error as a row instead of stopping at the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.residues import ALPHABET, MAX_LENGTH, MIN_LENGTH
from .similarity import pairs_at_least
from .tables import lookup, materialize


def _errors(df: DataFrame, checks: dict[str, Column], *keep: str) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks.items())))
    return df.select(*keep, F.explode(found).alias("error"))


def _duplicates(records: DataFrame) -> DataFrame:
    """``(record, error)`` of rows that share a seq. Keys are counted, and only those that repeat come back, their rows dealt over salts."""
    twice = records.groupBy("seq").agg(F.count("*").alias("_n")).where("_n > 1")
    return lookup(records.select("record", "seq"), "seq", "record", twice).where("_n > 1").select("record", F.lit("duplicate").alias("error"))


def library_errors(records: DataFrame, count: int | None = None, low: int = MIN_LENGTH, high: int = MAX_LENGTH, alphabet: str = ALPHABET) -> DataFrame:
    """``(record, error)`` of ``records (record, header, seq)``; a wrong count is an error of record 0."""
    records = materialize(records.select("record", "header", "seq"), "records")  # read several times: made once
    seq = F.coalesce("seq", F.lit(""))
    checks = {
        "blank header": F.trim(F.coalesce("header", F.lit(""))) == "",
        "empty sequence": seq == "",
        "illegal letter": seq.rlike(f"[^{alphabet}]"),
        "too short": (F.length(seq) < low) & (seq != ""),
        "too long": F.length(seq) > high,
    }
    out = _errors(records, checks, "record").unionByName(_duplicates(records.where(seq != "")))
    if count is not None:
        total = records.agg(F.count("*").alias("n")).where(F.col("n") != count)
        out = out.unionByName(total.select(F.lit(0).cast("long").alias("record"), F.concat(F.lit("count "), F.col("n").cast("string")).alias("error")))
    return out


def ranked_list_errors(top: DataFrame, library: DataFrame, k: int) -> DataFrame:
    """``(record, error)`` of a ranked list ``(record, seq)``: count, membership, duplicates."""
    member = top.join(library.select("seq", F.lit(True).alias("_in")).distinct(), "seq", "left")
    out = _errors(member, {"not in library": F.col("_in").isNull()}, "record").unionByName(_duplicates(top))
    total = top.agg(F.count("*").alias("n")).where(F.col("n") != k)
    return out.unionByName(total.select(F.lit(0).cast("long").alias("record"), F.concat(F.lit("count "), F.col("n").cast("string")).alias("error")))


def too_similar(seqs: DataFrame, reference: DataFrame, percent: int = 80) -> DataFrame:
    """Pairs strictly above the threshold; the list is valid if there are none."""
    return pairs_at_least(seqs, reference, percent, strict=True)


def output_errors(library: DataFrame, top: DataFrame, reference: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """``(part, error)`` over a whole release: library, ranked list, overlap with the reference, and similar pairs in the list."""
    parts = [
        library_errors(library, sizes[0]).select(F.lit("library").alias("part"), "error"),
        ranked_list_errors(top, library, sizes[1]).select(F.lit("top").alias("part"), "error"),
        library.join(reference.select("seq").distinct(), "seq", "left_semi").select(F.lit("library").alias("part"), F.lit("in reference").alias("error")),
        too_similar(top, reference).select(F.lit("top").alias("part"), F.lit("similar to reference").alias("error")),
        too_similar(top, top).where("a < b").select(F.lit("top").alias("part"), F.lit("similar pair").alias("error")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def require_none(errors: DataFrame, show: int = 20) -> None:
    """Raise with the first errors and their number, if there are any."""
    rows = errors.limit(show).collect()
    if rows:
        raise ValueError(f"{errors.count()} errors: " + "; ".join(str(r.asDict()) for r in rows))


def content_hash(df: DataFrame) -> int:
    """Order-insensitive digest of all rows, to compare two runs."""
    return int(df.agg(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("h")).first()["h"] or 0)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
