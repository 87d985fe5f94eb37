"""Grow a pool of candidate sequences from files that arrive over time: only new files are read, each sequence enters once.

A file stream reads the documents; its checkpoint knows the files that were taken. Each micro-batch writes its own
folder ``<out>/batch=<number>``, partitioned by length class: the sequences that no earlier batch has and that are not
in the known collection, with the source that brought them first, its properties, and whether a label forbids them. A
forbidden sequence stays in the pool as ``blocked``, so that no later copy enters. What came before is read from the
folders of lower numbers, so a batch that is repeated after a failure writes the same rows again. Once the pool has
``target`` open sequences, further files add nothing.

    python -m jobs.candidate_pool --documents D --labels L --known K --out OUT --checkpoint C --config jobs/candidate_pool.json
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, read_parquet, sequences
from seqloom.functions import residues as R
from seqloom.operators import sets

PATHS = {"documents": "folder or file of Parquet (doc_id, text, source)", "labels": "Parquet table (doc_id, toxic)", "known": "Parquet table (text)", "out": "folder of the pool", "checkpoint": "folder of the stream's checkpoint"}
DEFAULTS: dict[str, object] = {"low": 8, "high": 50, "class_width": 5, "files_per_batch": 1000, "target": None}
INPUT = "doc_id bigint, text string, source string"
POOL = "seq string, doc_id bigint, source string, copies bigint, blocked boolean, length int, charge double, hydrophobicity double, moment double, batch int, length_class int"


def fresh(rows: DataFrame, labels: DataFrame, known: DataFrame, before: DataFrame, low: int, high: int, width: int) -> DataFrame:
    """The pool's new rows from documents ``rows``. Rows of one sequence become one before any join, so a text of many copies is one row."""
    toxic = labels.where("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit(True))
    first = F.min(F.struct("doc_id", "source")).alias("first")
    found = sequences(rows, low, high).join(toxic, "doc_id", "left").groupBy("seq").agg(first, F.count("*").alias("copies"), F.coalesce(F.max("toxic"), F.lit(False)).alias("blocked"))
    found = sets.exclude(sets.exclude(found, sequences(known.select("text"), None, None)), before)
    seq, size = F.col("seq"), F.length("seq")
    return found.select(
        "seq", "first.doc_id", "first.source", "copies", "blocked", size.alias("length"), R.net_charge(seq).alias("charge"), R.mean_scale(seq).alias("hydrophobicity"),
        R.moment(seq).alias("moment"), (size - F.pmod(size, F.lit(width))).alias("length_class"),
    )


def run(spark: SparkSession, documents: str, labels: str, known: str, out: str, checkpoint: str, low: int, high: int, class_width: int, files_per_batch: int, target: int | None) -> DataFrame:
    """Take what is new in ``documents`` until nothing is left, and return the whole pool. A second run over the same files adds nothing."""

    if not (1 <= low <= high and class_width >= 1 and files_per_batch >= 1 and (target is None or target >= 1)):
        raise ValueError("need 1 <= low <= high, and class_width, files_per_batch and target of at least 1")

    def step(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        before = read_parquet(session, out, POOL).where(F.col("batch") < number)
        if target is not None and before.where("NOT blocked").count() >= target:
            log.info("candidate_pool: batch %s: the pool has its %s sequences", number, target)
            return
        read, wrote = Observation(f"read{number}"), Observation(f"wrote{number}")
        new = fresh(rows.observe(read, F.count("*").alias("rows")), session.read.parquet(labels), session.read.parquet(known), before, low, high, class_width)
        new = new.observe(wrote, F.count("*").alias("rows"), F.count_if("blocked").alias("blocked"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("length_class").parquet(f"{out}/batch={number}")
        log.info("candidate_pool: batch %s: read %s rows of %s; wrote %s sequences, %s of them blocked, to %s", number, read.get["rows"], documents, wrote.get["rows"], wrote.get["blocked"], out)

    # The last letter in braces: a glob that names this one path, be it a folder or a file (a stream takes no path of a file).
    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files_per_batch).parquet(f"{documents.rstrip('/')[:-1]}{{{documents.rstrip('/')[-1]}}}")
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_parquet(spark, out, POOL)


def added(pool: DataFrame) -> DataFrame:
    """``(batch, source, added)``: how many sequences each source brought first."""
    return pool.where("NOT blocked").groupBy("batch", "source").agg(F.count("*").alias("added"))


if __name__ == "__main__":
    main(run, PATHS, DEFAULTS)
