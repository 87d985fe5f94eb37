"""Resumable stages: checksums, fingerprints, pinned manifests, stamps that prove a result, and a run lock.

A stamp is written and read by Spark, beside results on any file system. It holds a tree of hashes: the SHA-256 of each
part file, computed by tasks, and one over the sorted parts of each batch. A part that is damaged, missing or foreign
changes its batch's tree, and only that batch runs again.
"""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import re
import subprocess
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def fingerprint(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def check_files(expected: dict[str, str], root: str = ".") -> None:
    """Every file must exist with its checksum; all differences are named at once."""
    wrong = [p for p, h in expected.items() if not (q := Path(root, p)).is_file() or file_sha256(str(q)) != h]
    if wrong:
        raise ValueError(f"missing or changed: {wrong}")


def _missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def read_stamps(spark: SparkSession, path: str) -> dict[str, dict]:
    """The stamps below a folder, by name; none where there is no folder."""
    try:
        rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select("value").collect()
    except AnalysisException as e:
        if not _missing(e):
            raise
        rows = []
    found = [json.loads(r["value"]) for r in rows if r["value"].strip()]
    return {x["name"]: x for x in found}


def write_stamp(spark: SparkSession, path: str, name: str, content: dict) -> None:
    """One stamp, replaced as a whole."""
    text = json.dumps({"name": name} | content, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def part_trees(spark: SparkSession, path: str, depth: int = 1) -> dict[str, str]:
    """One hash per folder below ``path`` that holds part files: over the names, below that folder, and contents of its parts.

    Files are read by tasks, each whole: a part must be below 2 GB. The driver gets one row per folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*")
    try:
        rows = files.load(path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return {}
    root = "/" + path.rstrip("/").split("/")[-1] + "/"
    below = F.split(F.element_at(F.split("path", re.escape(root)), -1), "/")
    part = F.concat(F.array_join(F.slice(below, depth + 1, F.greatest(F.size(below) - depth, F.lit(0))), "/"), F.lit(":"), F.sha2("content", 256))
    each = rows.select(F.array_join(F.slice(below, 1, depth), "/").alias("folder"), part.alias("part"))
    trees = each.groupBy("folder").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("part")), "\n"), 256).alias("tree"))
    return {r["folder"]: r["tree"] for r in trees.collect()}


def pin(spark: SparkSession, path: str, settings: dict) -> None:
    """Write the settings of a run, or refuse to go on with others than it began with."""
    old = read_stamps(spark, path).get("settings")
    if old is None:
        write_stamp(spark, path, "settings", {"settings": settings})
    elif fingerprint(old["settings"]) != fingerprint(settings):
        known = old["settings"]
        raise ValueError(f"{path}: {sorted(k for k in known.keys() | settings.keys() if known.get(k) != settings.get(k))} changed since the run began")


@contextlib.contextmanager
def run_lock(path: str) -> Iterator[None]:
    """One run at a time; a second one fails at once."""
    with open(path, "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise RuntimeError(f"{path}: another run holds the lock") from e
        yield


def resumable(stamps: str, batches: DataFrame, path: str, step: Callable[[DataFrame], DataFrame], inputs: str, batch: str = "batch") -> DataFrame:
    """Run ``step`` for each batch whose result is not proven by a stamp for these inputs; return all batches.

    Each batch is written to a folder of its own, replaced as a whole, and stamped with its tree of hashes after the
    commit: a batch that broke off has no stamp, and one whose parts changed since has another tree.
    """
    spark = batches.sparkSession
    numbers = sorted(r[0] for r in batches.select(batch).distinct().collect())
    known, trees = read_stamps(spark, stamps), part_trees(spark, path)
    for n in numbers:
        name = f"{batch}={n}"
        stamp = known.get(name, {})
        if stamp.get("inputs") == inputs and stamp.get("tree") == trees.get(name):
            continue
        step(batches.where(F.col(batch) == n)).write.mode("overwrite").parquet(f"{path}/{name}")
        write_stamp(spark, stamps, name, {"inputs": inputs, "tree": part_trees(spark, f"{path}/{name}", 0).get("")})
    return spark.read.parquet(*(f"{path}/{batch}={n}" for n in numbers)) if numbers else step(batches)


def stage(path: str, signature: dict, build: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """A Parquet result that is reused while its signature and its parts stay the same. The stamp is the folder ``<path>.stamp``."""
    stamp = read_stamps(spark, f"{path}.stamp").get("stage", {})
    tree = part_trees(spark, path, 0).get("") if stamp else None
    if stamp.get("signature") != fingerprint(signature) or stamp.get("tree") != tree:
        build().write.mode("overwrite").parquet(path)
        write_stamp(spark, f"{path}.stamp", "stage", {"signature": fingerprint(signature), "tree": part_trees(spark, path, 0).get("")})
    return spark.read.parquet(path)


def source_state(repository: str = ".") -> dict[str, object]:
    """Head and dirtiness of a git checkout; empty where there is none."""
    git = lambda *a: subprocess.run(["git", "-C", repository, *a], capture_output=True, text=True)
    head = git("rev-parse", "HEAD")
    return {} if head.returncode else {"head": head.stdout.strip(), "dirty": bool(git("status", "--porcelain").stdout.strip())}
