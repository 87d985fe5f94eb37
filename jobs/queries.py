"""The jobs as queries: each runs twice into one new folder of the shared place and returns its whole output, beside SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import candidate_pool, training_splits
from seqloom.operators.tables import shared_dir
from seqloom.plans import catalogue as C


def job1_training_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/jobs/{uuid.uuid4().hex}"
    for _ in range(2):
        out = training_splits.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", base, **training_splits.DEFAULTS)
    return out


def job2_candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_dir(spark)}/jobs/{uuid.uuid4().hex}"
    for _ in range(2):
        out = candidate_pool.run(spark, *(f"{sf_dir}/{t}.parquet" for t in ("documents", "labels", "conversations")), f"{base}/pool", f"{base}/checkpoint", **candidate_pool.DEFAULTS)
    return out.select("seq", "doc_id", "source", "copies", "blocked", "length", "length_class", *(C.r6(F.col(c)).alias(c) for c in ("charge", "hydrophobicity", "moment")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_training_splits, job2_candidate_pool)}

_LABELLED = "lb AS (SELECT seq, max(quality)::INT AS label FROM c JOIN labels USING (doc_id) WHERE quality IN (0, 1) GROUP BY seq), d AS (SELECT seq FROM lb)"
_FAMILIES = ", ".join((C.SQL["c"], _LABELLED, C._CHARS_SQL, C._SELF_SQL, C._LCS_SQL, C._BOTH_SQL, C._REACH_SQL))
_SEQ = f"regexp_replace(text, '{C.LETTERS}', '', 'g')"

ORACLES: dict[str, str] = {
    "job1_training_splits": f"""
WITH RECURSIVE {_FAMILIES}, fm AS (SELECT seq, min(other) AS family FROM rc GROUP BY seq),
pt AS (SELECT *, ('0x' || substr(sha256('42:' || family), 1, 8))::BIGINT % 100 AS point FROM fm JOIN lb USING (seq))
SELECT seq, sha256(seq) AS sequence_id, length(seq)::INT AS length, family, CASE WHEN point < 80 THEN 'train' WHEN point < 90 THEN 'dev' ELSE 'audit' END AS split, label FROM pt""",
    "job2_candidate_pool": f"""
WITH s AS (SELECT doc_id, source, {_SEQ} AS seq, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM documents),
g AS (SELECT seq, min(struct_pack(doc_id := doc_id, source := source)) AS first, count(*) AS copies, max(toxic) AS blocked FROM s WHERE length(seq) BETWEEN 8 AND 50 GROUP BY seq),
d AS (SELECT * FROM g WHERE seq NOT IN (SELECT {_SEQ} FROM conversations WHERE text IS NOT NULL)),
{C._CHARS_SQL}, {C._SCALE_SQL},
p AS (SELECT seq, sqrt(pow(sum(v * cos((k - 1) * radians(100))), 2) + pow(sum(v * sin((k - 1) * radians(100))), 2)) / any_value(length(seq)) AS moment FROM x JOIN h USING (aa) GROUP BY seq)
SELECT seq, first.doc_id AS doc_id, first.source AS source, copies, blocked, length(seq)::INT AS length, (length(seq) - length(seq) % 5)::INT AS length_class,
  round(1 / (1 + pow(10, 7 - 8.0)) - 1 / (1 + pow(10, 3.1 - 7)) + {C._counts_sql(C._CHARGES)}, 6) AS charge, round(({C._counts_sql(C.R.EISENBERG)}) / length(seq), 6) AS hydrophobicity, round(moment, 6) AS moment FROM d JOIN p USING (seq)""",
}
