"""What the jobs share: their command line, their log, and sequences of text tables."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import residues as R

log = logging.getLogger("seqloom.jobs")


def sequences(texts: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """``texts`` with ``seq`` instead of ``text``: the canonical capital letters of the whole text, where they are ``low`` to ``high`` many."""
    rows = texts.withColumn("seq", F.regexp_replace("text", f"[^{R.ALPHABET}]", "")).drop("text")
    return rows.where(R.canonical(F.col("seq"), low, high))


def read_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table with a stated schema; one that was never written is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def settings(path: str | Path, defaults: Mapping[str, object]) -> dict[str, object]:
    """The settings of a JSON file over the defaults; a key that the job does not know is an error."""
    given = json.loads(Path(path).read_text(encoding="utf-8"))
    if unknown := set(given) - set(defaults):
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}")
    return dict(defaults) | given


def main(run: Callable[..., object], paths: Mapping[str, str], defaults: Mapping[str, object], argv: list[str] | None = None) -> None:
    """Command line: one option a path, ``--config`` for the settings. Creates the session and stops it."""
    parser = argparse.ArgumentParser(description=sys.modules[run.__module__].__doc__)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", help="JSON file of settings; without it, the defaults")
    args = vars(parser.parse_args(argv))
    config = args.pop("config")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, **args, **(settings(config, defaults) if config else dict(defaults)))
    finally:
        spark.stop()
