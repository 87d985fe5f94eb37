"""Readers: FASTA in four strictnesses, score tables, alignments, JSON releases, embeddings and their cache."""

from __future__ import annotations

import glob
import hashlib
import io
import json
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.residues import canonical
from ..operators.ranking import numbered


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Lenient: ``(header, seq)``; records split at lines that begin with ``>``, wrapped lines joined, blank and ``;`` lines skipped.

    Files are split between records by the text source, so a large file is read by many tasks.
    """
    text = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", "^>", ""))
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    body = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: (F.trim(x) != "") & ~F.trim(x).startswith(";"))
    out = text.select(F.trim(lines[0]).alias("header"), F.regexp_replace(F.array_join(body, ""), r"\s", "").alias("seq"))
    # Comments before the first record make a record without a sequence.
    return out.where((F.col("seq") != "") | ~F.col("header").startswith(";"))


def clean_sequences(records: DataFrame, key: str = "seq") -> DataFrame:
    """Upper-case canonical sequences of 8 to 50 letters, each once, in order."""
    return records.select(F.upper(key).alias(key)).where(canonical(F.col(key))).distinct().orderBy(key)


def read_clean_fasta(spark: SparkSession, path: str) -> DataFrame:
    return clean_sequences(read_fasta(spark, path))


def read_template_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(record, header, seq)`` with upper-case sequences, numbered from 1 in file order; nothing is filtered."""
    rows = read_fasta(spark, path).withColumn("_id", F.monotonically_increasing_id())
    return numbered(rows, "_id", "record").select((F.col("record") + 1).alias("record"), "header", F.upper("seq").alias("seq"))


def read_strict_fasta(spark: SparkSession, path: str, candidate: bool = False) -> DataFrame:
    """``(header, seq)`` or an error: no blank header, no empty or illegal sequence, no text before the first record, no empty file.

    ``candidate`` also demands 8 to 50 letters and unique sequences.
    """
    raw = spark.read.text(path)
    first = raw.where(F.trim("value") != "").limit(1).collect()
    if not first or not first[0][0].startswith(">"):
        raise ValueError(f"{path}: empty, or text before the first header")
    rows = read_fasta(spark, path)
    bad = F.when(F.col("header") == "", "blank header").when(F.col("seq") == "", "empty sequence").when(~canonical(F.col("seq"), None, None), "illegal residue")
    if candidate:
        bad = bad.when(~canonical(F.col("seq")), "length")
    errors = rows.select("header", bad.alias("error")).where("error is not null").limit(5).collect()
    if errors:
        raise ValueError(f"{path}: {[tuple(e) for e in errors]}")
    if candidate and not rows.groupBy("seq").count().where("count > 1").isEmpty():
        raise ValueError(f"{path}: repeated sequences")
    return rows


def _require(df: DataFrame, condition, message: str) -> DataFrame:
    bad = df.where(~F.coalesce(condition, F.lit(False))).limit(3).collect()
    if bad:
        raise ValueError(f"{message}: {[r.asDict() for r in bad]}")
    return df


def _unique(df: DataFrame, key: str) -> DataFrame:
    bad = df.groupBy(key).count().where("count > 1").limit(3).collect()
    if bad:
        raise ValueError(f"repeated {key}: {[r[0] for r in bad]}")
    return df


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    first = spark.read.text(path).first()
    columns = [c.strip() for c in (first[0] if first else "").split(sep)]
    if len(set(columns)) != len(columns):
        raise ValueError(f"{path}: repeated columns")
    return columns


def finite(c) -> F.Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def read_scores(spark: SparkSession, path: str, prob: str = "amplify_prob", mic: str = "mbc-attention_MIC_uM") -> DataFrame:
    """``(seq, prob, mic)``: unique upper-case keys, prob in [0, 1], mic above 0, all finite; further columns are ignored."""
    columns = header_of(spark, path)
    if missing := {"sequence", prob, mic} - set(columns):
        raise ValueError(f"{path}: no columns {sorted(missing)}")
    schema = T.StructType([T.StructField(c, T.DoubleType() if c in (prob, mic) else T.StringType()) for c in columns])
    rows = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST").select(F.upper(F.trim("sequence")).alias("seq"), F.col(f"`{prob}`").alias("prob"), F.col(f"`{mic}`").alias("mic"))
    return _unique(_require(rows, finite(F.col("prob")) & finite(F.col("mic")) & F.col("prob").between(0, 1) & (F.col("mic") > 0), "scores out of range"), "seq")


def read_model_scores(spark: SparkSession, path: str, models: list[dict], seqs: DataFrame | None = None) -> DataFrame:
    """Long scores ``(seq, model, family, kind, value)`` of the models that a schema names; every requested sequence needs every score.

    ``models``: dicts of column, family, kind (amp_probability or mic_um) and target.
    """
    if not models or any(m["kind"] not in ("amp_probability", "mic_um") for m in models):
        raise ValueError("no models, or an unknown kind")
    columns = header_of(spark, path)
    if missing := {"sequence", *(m["column"] for m in models)} - set(columns):
        raise ValueError(f"{path}: no columns {sorted(missing)}")
    wanted = {m["column"] for m in models}
    schema = T.StructType([T.StructField(c, T.DoubleType() if c in wanted else T.StringType()) for c in columns])
    wide = _unique(spark.read.csv(path, header=True, schema=schema, mode="FAILFAST").withColumn("seq", F.upper(F.trim("sequence"))), "seq")
    if seqs is not None:
        wide = seqs.select("seq").join(wide, "seq", "left")
    one = lambda m: F.struct(F.lit(m["column"]).alias("model"), F.lit(m["family"]).alias("family"), F.lit(m["kind"]).alias("kind"), F.col(f"`{m['column']}`").alias("value"))
    rows = wide.select("seq", F.explode(F.array(*map(one, models))).alias("m")).select("seq", "m.*")
    ok = finite(F.col("value")) & F.when(F.col("kind") == "mic_um", F.col("value") > 0).otherwise(F.col("value").between(0, 1))
    return _require(rows, ok, "scores missing or out of range")


def read_bits(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", schema="query string, target string, bits double", mode="FAILFAST")
    return _require(rows, finite(F.col("bits")) & (F.col("bits") >= 0), "bits")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """13-column alignment rows; see ``operators.sets.alignment_columns`` for the derived ones."""
    numbers = ("nident", "alnlen", "qstart", "qend", "tstart", "tend", "qlen", "tlen")
    schema = "query string, target string, bits double, raw double, " + ", ".join(f"{c} int" for c in numbers) + ", cigar string"
    return spark.read.csv(path, sep="\t", schema=schema, mode="FAILFAST")


def read_release(spark: SparkSession, path: str, sha256: str | None = None, count: int | None = None) -> DataFrame:
    """JSON array of records ``(id, sequence, databases)``: checksum, exact count, unique ids without white space, canonical sequences."""
    if sha256 is not None:
        got = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()["h"]
        if got != sha256:
            raise ValueError(f"{path}: checksum {got}")
    rows = spark.read.json(path, schema="id string, sequence string, databases array<string>", multiLine=True)
    if count is not None and (n := rows.count()) != count:
        raise ValueError(f"{path}: {n} records")
    return _unique(_require(rows, F.col("id").rlike(r"^\S+$") & canonical(F.col("sequence"), None, None), "records"), "id")


def read_npz_embeddings(spark: SparkSession, path: str, seqs: DataFrame | None = None) -> DataFrame:
    """``(seq, model, embedding)`` of NPZ files with arrays sequences, embeddings and model; a requested sequence without a vector is an error."""
    schema = "seq string, model string, embedding array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                z = np.load(io.BytesIO(content), allow_pickle=False)
                names, x = z["sequences"].astype(str), z["embeddings"].astype(np.float32)
                if x.ndim != 2 or len(x) != len(names) or not np.isfinite(x).all():
                    raise ValueError("embeddings don't match their sequences, or are not finite")
                yield pd.DataFrame({"seq": names, "model": str(z["model"]), "embedding": list(x)})

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)
    if seqs is not None:
        lost = seqs.select("seq").join(rows.select("seq"), "seq", "left_anti").limit(3).collect()
        if lost:
            raise ValueError(f"no embedding for {[r[0] for r in lost]}")
        rows = seqs.select("seq").join(rows, "seq")
    return rows


def cached_embeddings(spark: SparkSession, path: str, seqs: DataFrame, model: str, embed: Callable[[list[str]], np.ndarray], batch: int = 32) -> DataFrame:
    """``(seq, model, embedding)`` of the distinct sequences: known ones from the Parquet table at ``path``, the rest computed, appended and read back."""
    schema = "seq string, model string, embedding array<float>"
    wanted = seqs.select("seq").distinct()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    known = spark.read.schema(schema).parquet(path).where(F.col("model") == model) if exists else spark.createDataFrame([], schema)
    missing = wanted.join(known.select("seq"), "seq", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame["seq"].iloc[at : at + batch].tolist()
                yield pd.DataFrame({"seq": part, "model": model, "embedding": list(np.asarray(embed(part), np.float32))})

    if not missing.isEmpty():
        missing.mapInPandas(run, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).where(F.col("model") == model).join(wanted, "seq", "left_semi") if exists or not wanted.isEmpty() else known


def fetch(url: str, path: str, sha256: str, tries: int = 3, opener: Callable = urllib.request.urlopen) -> str:
    """Download a FASTA file once, if it is not there with this checksum; a driver utility."""
    target, last = Path(path), ""
    if target.exists() and hashlib.sha256(target.read_bytes()).hexdigest() == sha256:
        return path
    for _ in range(tries):
        try:
            with opener(url, timeout=60) as r:
                data = r.read()
            if data.lstrip()[:1] == b">" and hashlib.sha256(data).hexdigest() == sha256:
                part = target.with_suffix(target.suffix + ".part")
                part.write_bytes(data)
                part.replace(target)
                return path
            last = "not FASTA, or another checksum"
        except OSError as e:
            last = str(e)
    raise ValueError(f"{url}: {last}")


def accepted_pools(pattern: str, checkpoint_sha256: str) -> list[str]:
    """Pool files beside a ``*.json`` manifest that names this checkpoint and the file's own checksum."""
    out = []
    for m in sorted(glob.glob(pattern)):
        info = json.loads(Path(m).read_text())
        pool = Path(m).with_suffix(".fasta")
        if info.get("checkpoint") == checkpoint_sha256 and pool.exists() and info.get("sha256") == hashlib.sha256(pool.read_bytes()).hexdigest():
            out.append(str(pool))
    return out


def read_score_report(spark: SparkSession, path: str, models: list[str]) -> DataFrame:
    """A report ``[{model, status}]``; a requested model that is not ok is an error."""
    rows = spark.read.json(path, schema="model string, status string", multiLine=True)
    wanted = spark.createDataFrame([(m,) for m in models], "model string")
    _require(wanted.join(rows, "model", "left"), F.col("status") == "ok", "models without scores")
    return rows
