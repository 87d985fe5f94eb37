import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.errors import StreamingQueryException

from jobs import candidate_pool, common, queries, training_splits
from seqloom.operators import similarity

from .test_queries import TABLES, D, plain

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DOCS = "doc_id bigint, text string, source string, extra int"
A, B, C, D, E = "ACDEFGHIKL", "MNPQRSTVWY", "AAAAAAAAAA", "WWWWWWWWWW", "CCCCCCCCCC"


def tables(spark, base, docs, labels=(), known=()):
    spark.createDataFrame(docs, DOCS).write.mode("append").parquet(f"{base}/documents")
    spark.createDataFrame(list(labels), "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{base}/labels")
    spark.createDataFrame([(1, t) for t in known], "conv_id bigint, text string").write.mode("overwrite").parquet(f"{base}/known")


def pool(spark, base, **more):
    paths = [f"{base}/{t}" for t in ("documents", "labels", "known", "pool", "checkpoint")]
    return candidate_pool.run(spark, *paths, **(candidate_pool.DEFAULTS | more))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_pool_takes_only_what_is_new(spark, tmp_path):
    base = f"file://{tmp_path}"
    tables(spark, base, [(3, A, "s1", 0), (2, f"x {A} y", "s2", 0), (5, B, "s1", 0), (6, None, "s1", 0), (7, "", None, 0), (None, C, None, 0), (8, "A" * 51, "s", 0)], [(5, 0, 1), (5, None, 1), (2, 1, None)], [f"say {D}", None])
    first = pool(spark, base)
    columns = ("seq", "doc_id", "source", "copies", "blocked", "batch", "length_class")
    assert rows(first, *columns[:1], *columns[3:]) == [(C, 1, False, 0, 10), (A, 2, False, 0, 10), (B, 1, True, 0, 10)]
    again = pool(spark, base)
    assert rows(again, *columns[3:]) == rows(first, *columns[3:]) and again.count() == 3
    # Growth: an old sequence, a copy of a blocked one, a known one and a new one.
    tables(spark, base, [(1, A, "s3", 0), (9, B, "s3", 0), (10, D, "s3", 0), (11, E, "s3", 0)], [(5, 0, 1)], [f"say {D}"])
    for _ in range(2):
        grown = pool(spark, base)
        assert rows(grown, "seq", "source", "batch", "blocked") == sorted([(C, None, 0, False), (A, "s2", 0, False), (B, "s1", 0, True), (E, "s3", 1, False)])
        assert rows(candidate_pool.added(grown.where("source IS NOT NULL")), "batch", "source", "added") == [(0, "s2", 1), (1, "s3", 1)]


def test_pool_survives_a_stream_that_dies(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}"
    tables(spark, base, [(1, A, "s1", 0)])
    pool(spark, base)
    tables(spark, base, [(2, B, "s2", 0), (3, A, "s2", 0)])

    def die(*_):
        raise OSError("lost after the write, before the commit")

    with monkeypatch.context() as m:
        m.setattr(candidate_pool.log, "info", die)
        with pytest.raises(StreamingQueryException):
            pool(spark, base)
    tables(spark, base, [(4, C, "s3", 0)])
    assert rows(pool(spark, base), "seq", "batch") == [(C, 2), (A, 0), (B, 1)]


def test_pool_stops_at_its_target_and_reads_an_empty_table(spark, tmp_path):
    base = f"file://{tmp_path}"
    tables(spark, base, [])
    assert pool(spark, base, target=2).count() == 0
    tables(spark, base, [(1, A, "s1", 0), (2, B, "s1", 0), (3, C, "s1", 0)])
    assert pool(spark, base, target=2).count() == 3
    tables(spark, base, [(4, D, "s2", 0)])
    assert pool(spark, base, target=2).count() == 3


def test_pool_in_small_batches_has_the_same_sequences(spark, tmp_path):
    base = f"file://{tmp_path}"
    letters = "ACDEFGHIKLMNPQRSTVWY"
    tables(spark, base, [(k, letters[k % 20] * 8 + letters[k // 20] * 2, f"s{k % 3}", 0) for k in range(90)])
    one = pool(spark, base)
    paths = [f"{base}/{t}" for t in ("documents", "labels", "known", "pool2", "checkpoint2")]
    small = candidate_pool.run(spark, *paths, **(candidate_pool.DEFAULTS | {"files_per_batch": 1}))
    assert rows(small, "seq", "doc_id", "source") == rows(one, "seq", "doc_id", "source") and small.select("batch").distinct().count() > 1


def test_splits_keep_families_whole_and_rerun(spark, tmp_path):
    base = f"file://{tmp_path}"
    letters = "CDEFGHIKLMNPQRSTVWY"
    docs = [(k, letters[k % 19] * 10 + "A" * (k // 19), "s", 0) for k in range(57)] + [(100, "C" * 10, "s", 0), (101, None, "s", 0), (102, "short", "s", 0)]
    tables(spark, base, docs, [(k, k % 2, 0) for k in range(57)] + [(100, 1, 0), (101, 1, 0), (102, None, 0), (1, 1, 0)])
    defaults = training_splits.DEFAULTS | {"release": "r1", "percent": {"train": 50, "dev": 30, "audit": 20}}
    run = lambda **more: training_splits.run(spark, f"{base}/documents", f"{base}/labels", f"{base}/out", **(defaults | more))
    got = run()
    first = rows(got, *got.columns)
    got = run()
    assert rows(got, *got.columns) == first
    labels = {r["seq"]: r["label"] for r in got.collect()}
    assert len(labels) == len(first) == 57 and labels["C" * 10] == 1 and labels["D" * 10] == 1 and labels["E" * 10] == 0
    families = {r["seq"]: r["family"] for r in similarity.families(got).collect()}
    split = {}
    for r in got.collect():
        assert r["family"] == families[r["seq"]] and split.setdefault(r["family"], r["split"]) == r["split"]
    assert set(split.values()) == {"train", "dev", "audit"}
    # Another release leaves the first alone; a rerun on other rows leaves nothing stale.
    assert run(release="r2", percent={"train": 100, "dev": 0, "audit": 0}).select("split").distinct().collect()[0][0] == "train"
    assert rows(spark.read.schema(training_splits.OUTPUT).parquet(f"{base}/out/release=r1"), *got.columns) == first
    assert {r[0] for r in run(percent={"train": 100, "dev": 0, "audit": 0}).select("split").collect()} == {"train"}


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_registered_job_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got, expected = queries.QUERIES[name](spark, D).toPandas(), con.execute(queries.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) and plain(got) == plain(expected)


def test_settings(tmp_path):
    for job, name in ((candidate_pool, "candidate_pool"), (training_splits, "training_splits")):
        assert set(common.settings(f"{ROOT}/jobs/{name}.json", job.DEFAULTS)) == set(job.DEFAULTS)
    (tmp_path / "bad.json").write_text('{"targte": 3}')
    with pytest.raises(ValueError, match="targte"):
        common.settings(tmp_path / "bad.json", candidate_pool.DEFAULTS)


def test_settings_out_of_range(spark):
    for job, paths, wrong in ((candidate_pool, 5, {"low": 9, "high": 8}), (candidate_pool, 5, {"target": 0}), (candidate_pool, 5, {"class_width": 0}), (training_splits, 3, {"similarity": 0}), (training_splits, 3, {"release": "."})):
        with pytest.raises(ValueError, match="need"):
            job.run(spark, *["nowhere"] * paths, **(job.DEFAULTS | wrong))


def test_command_line(spark, tmp_path):
    base = f"file://{tmp_path}"
    tables(spark, base, [(1, A, "s1", 0), (2, A, "s1", 0)])
    (tmp_path / "config.json").write_text(json.dumps({"class_width": 10}))
    args = [x for t in ("documents", "labels", "known", "pool", "checkpoint") for x in ("--out" if t == "pool" else f"--{t}", f"{base}/{t}")]
    env = os.environ | {"SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-m", "jobs.candidate_pool", *args, "--config", f"{tmp_path}/config.json"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 2 rows" in done.stderr and "wrote 1 sequences" in done.stderr
    assert rows(spark.read.schema(candidate_pool.POOL).parquet(f"{base}/pool"), "seq", "copies", "length_class") == [(A, 2, 10)]


def test_jobs_need_no_training_data_operators():
    code = "import sys; import jobs.queries, jobs.candidate_pool, jobs.training_splits; assert not [m for m in sys.modules if m.startswith('seqloom.llm') or m == 'corpus_pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
