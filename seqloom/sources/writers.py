"""Writers: FASTA, CSV and TSV forms, JSON, reports, and a publish step that is all or nothing.

Distributed forms write folders through Spark. Single-file forms stream partitions to the driver in order, write a
temporary file beside the target and rename it.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered

def replace_file(path: str, parts: Iterable[str] | bytes) -> None:
    part = f"{path}.part"
    if isinstance(parts, bytes):
        Path(part).write_bytes(parts)
    else:
        with open(part, "w", encoding="utf-8", newline="") as f:
            f.writelines(parts)
    os.replace(part, path)


def write_fasta(df: DataFrame, path: str, key: str = "seq", form: str = "p%08d", offset: int = 0, order: list[str | Column] | None = None) -> None:
    """One file; ids are ``form % position`` from ``offset`` on, in ``order`` (else the key's)."""
    rows = df.orderBy(*(order or [key])).select(key).toLocalIterator()
    replace_file(path, (f">{form % (offset + k)}\n{r[0]}\n" for k, r in enumerate(rows)))


def write_fasta_parts(df: DataFrame, path: str, key: str = "seq", form: str = "p%08d", offset: int = 0, partitions: int | None = None) -> None:
    """A folder of parts that read one after the other as :func:`write_fasta` writes them, with the same ids, by tasks: nothing passes the driver.

    Rows are numbered in the order of the key and dealt by ranges of their numbers.
    """
    rows = numbered(df.select(key), key, "_at")
    record = F.format_string(f">{form}\n%s", F.col("_at") + offset, F.col(key))
    ranged = rows.repartitionByRange(partitions, "_at") if partitions else rows.repartitionByRange("_at")
    ranged.sortWithinPartitions("_at").select(record).write.mode("overwrite").text(path)


def write_records(df: DataFrame, path: str, prefix: str, offset: int = 0) -> None:
    write_fasta(df, path, form=prefix + "%09d", offset=offset)


def write_fasta_folder(df: DataFrame, path: str, key: str = "seq", header: Column | None = None) -> None:
    """Many files, one per partition; ids are SHA-256 of the sequence unless a header is given, so no order is needed."""
    df.select(F.concat(F.lit(">"), header if header is not None else F.sha2(key, 256), F.lit("\n"), F.col(key))).write.text(path)


def write_json(path: str, value: object) -> None:
    replace_file(path, [json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n"])


def write_scores(df: DataFrame, path: str, columns: dict[str, str], key: str = "seq") -> None:
    """CSV folder with numbers at 17 significant digits, which read back exactly. ``columns``: column -> header."""
    df.select(F.col(key).alias("sequence"), *(F.expr(f"format_string('%.16e', cast(`{c}` as double))").alias(h) for c, h in columns.items())).write.csv(path, header=True)


def write_candidates(df: DataFrame, path: str, key: str = "seq", score: str = "proxy") -> None:
    df.select(F.sha2(key, 256).alias("sequence_id"), F.col(key).alias("sequence"), score).write.csv(path, header=True)


def write_table(df: DataFrame, path: str, sep: str = "\t", compression: str | None = None) -> None:
    """Separated text; arrays, maps and structs become JSON cells."""
    cell = lambda f: F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`")
    writer = df.select(*map(cell, df.schema.fields)).write.option("sep", sep).option("header", True)
    (writer.option("compression", compression) if compression else writer).csv(path)


def write_npz(df: DataFrame, path: str, columns: list[str], order: str, most: int = 1_000_000) -> None:
    """A table of at most ``most`` rows as NPZ arrays, in order; more rows are an error, as the driver would hold them all."""
    rows = df.orderBy(order).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for one NPZ file")
    with open(f"{path}.part", "wb") as f:
        np.savez(f, **{c: np.array(rows[c].tolist()) for c in columns})
    os.replace(f"{path}.part", path)


def release_fasta(records: DataFrame, path: str) -> str:
    """Lossless FASTA of a release ``(id, sequence)`` in id order: gives its SHA-256."""
    digest = hashlib.sha256()

    def parts() -> Iterable[str]:
        for r in records.orderBy("id").select("id", "sequence").toLocalIterator():
            line = f">{r[0]}\n{r[1]}\n"
            digest.update(line.encode())
            yield line

    replace_file(path, parts())
    return digest.hexdigest()


def release_sources(records: DataFrame, path: str) -> None:
    write_table(records.select("id", F.explode("databases").alias("source")), path)


def markdown_table(df: DataFrame, digits: int = 4, most: int = 1000) -> str:
    """A small table as Markdown; more than ``most`` rows is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    cell = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def publish(files: dict[str, str], expected: dict[str, str], validate: Callable[[], None] | None = None) -> None:
    """Copy source -> target only if every source has its expected SHA-256; old targets go first, so a failure leaves none."""
    for target in files.values():
        Path(target).unlink(missing_ok=True)
    data = {source: Path(source).read_bytes() for source in files}
    for source, content in data.items():
        if (got := hashlib.sha256(content).hexdigest()) != expected[source]:
            raise ValueError(f"{source}: checksum {got}")
    if validate is not None:
        validate()
    for source, target in files.items():
        replace_file(target, data[source])
