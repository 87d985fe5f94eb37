"""Prepare training data: labelled sequences, grouped in families of similar ones, each family whole in one split.

Positives are the sequences of documents of quality 1, negatives those of quality 0 that are no positives as well.
Sequences with a similarity of at least ``similarity`` percent are of one family, and so are those that a chain of
such pairs connects: no split has a near copy of another's sequence. The release is written to
``<out>/release=<release>``, partitioned by split and label, and replaced as a whole when it is run again.

    python -m jobs.training_splits --documents D --labels L --out OUT --config jobs/training_splits.json
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, read_parquet, sequences
from seqloom.functions import residues as R
from seqloom.operators import allocation, sets, similarity

PATHS = {"documents": "Parquet table (doc_id, text)", "labels": "Parquet table (doc_id, quality)", "out": "folder of the releases"}
DEFAULTS: dict[str, object] = {"release": "latest", "similarity": 80, "percent": {"train": 80, "dev": 10, "audit": 10}, "seed": 42, "low": 8, "high": 50}
OUTPUT = "seq string, sequence_id string, length int, family string, split string, label int"


def run(spark: SparkSession, documents: str, labels: str, out: str, release: str, similarity: int, percent: dict[str, int], seed: int, low: int, high: int) -> DataFrame:  # noqa: A002
    """Write one release and return it as read back. Null texts, null labels and repeated rows are no trouble: a sequence comes once."""
    if not (1 <= low <= high and 1 <= similarity <= 100 and release.strip("/. ")):
        raise ValueError("need 1 <= low <= high, a similarity of 1 to 100, and a name for the release")
    seen, kept = Observation("documents"), Observation("labelled")
    docs = spark.read.parquet(documents).select("doc_id", "text").observe(seen, F.count("*").alias("rows"))
    marks = spark.read.parquet(labels).where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label"))
    classes = sequences(docs, low, high).join(marks, "doc_id").groupBy("seq").agg(F.max(F.col("label") == 1).alias("positive"), F.max(F.col("label") == 0).alias("negative"))
    positives, negatives = classes.where("positive").select("seq"), classes.where("negative").select("seq")
    clean, _ = sets.remove_conflicts(negatives, positives)
    members = positives.withColumn("label", F.lit(1)).unionByName(clean.withColumn("label", F.lit(0)))
    rows = _families(members, similarity)
    rows = allocation.hash_split(rows, percent, seed=seed).withColumn("sequence_id", R.sequence_id(F.col("seq"))).withColumn("length", F.length("seq"))
    rows = rows.observe(kept, F.count("*").alias("rows"), F.sum("label").alias("positive"))
    target = f"{out}/release={release}"
    rows.select("seq", "sequence_id", "length", "family", "split", "label").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("split", "label").parquet(target)
    log.info("training_splits: read %s rows of %s; wrote %s sequences, %s of them positive, to %s", seen.get["rows"], documents, kept.get["rows"], kept.get["positive"], target)
    return read_parquet(spark, target, OUTPUT)


def _families(members: DataFrame, percent: int) -> DataFrame:
    return members.join(similarity.families(members, percent), "seq")


if __name__ == "__main__":
    main(run, PATHS, DEFAULTS)
