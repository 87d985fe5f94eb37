import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.plans import manifest
from seqloom.sources import readers, writers
from seqloom.streaming import incremental


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_lenient_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fasta", "; comment\n>one first\nacde\n FGHI \n\n>two\n;skip\nACDEFGHIK\n>three\nacdefghix\n>four\nACDEFGHI\n")
    assert [tuple(r) for r in readers.read_fasta(spark, path).collect()] == [("one first", "acdeFGHI"), ("two", "ACDEFGHIK"), ("three", "acdefghix"), ("four", "ACDEFGHI")]
    assert [r[0] for r in readers.read_clean_fasta(spark, path).collect()] == ["ACDEFGHI", "ACDEFGHIK"]
    assert [r["record"] for r in readers.read_template_fasta(spark, path).collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("text", ["", "ACDE\n>x\nAC\n", ">\nACDE\n", ">x\n\n>y\nAC\n", ">x\nACXZ\n"])
def test_strict_fasta_rejects(spark, tmp_path, text):
    with pytest.raises(ValueError):
        readers.read_strict_fasta(spark, put(tmp_path, "a.fasta", text))


def test_strict_candidates(spark, tmp_path):
    good = put(tmp_path, "g.fasta", ">a\nACDEFGHI\n>b\nACDEFGHIK\n")
    assert readers.read_strict_fasta(spark, good, candidate=True).count() == 2
    for text in (">a\nACD\n", ">a\nACDEFGHI\n>b\nACDEFGHI\n"):
        with pytest.raises(ValueError):
            readers.read_strict_fasta(spark, put(tmp_path, "b.fasta", text), candidate=True)


def test_scores(spark, tmp_path):
    head = "sequence,extra,amplify_prob,mbc-attention_MIC_uM\n"
    path = put(tmp_path, "s.csv", head + " acd ,x,0.5,2.5\nEFG,y,1,0.125\n")
    assert {tuple(r) for r in readers.read_scores(spark, path).collect()} == {("ACD", 0.5, 2.5), ("EFG", 1.0, 0.125)}
    for row in ("A,x,1.5,1\n", "A,x,0.5,0\n", "A,x,NaN,1\n", "A,x,0.5,1\na,x,0.5,1\n"):
        with pytest.raises(ValueError):
            readers.read_scores(spark, put(tmp_path, "t.csv", head + row))
    models = [{"column": "amplify_prob", "family": "amp", "kind": "amp_probability", "target": ""}, {"column": "mbc-attention_MIC_uM", "family": "mbc", "kind": "mic_um", "target": ""}]
    assert readers.read_model_scores(spark, path, models).count() == 4
    with pytest.raises(ValueError):
        readers.read_model_scores(spark, path, models, spark.createDataFrame([("ACD",), ("ZZZ",)], "seq string"))


def test_alignment_files(spark, tmp_path):
    assert readers.read_bits(spark, put(tmp_path, "b.tsv", "q\tt\t1.5\n")).first()["bits"] == 1.5
    with pytest.raises(ValueError):
        readers.read_bits(spark, put(tmp_path, "c.tsv", "q\tt\t-1\n"))
    assert readers.read_alignments(spark, put(tmp_path, "d.tsv", "q\tt\t50\t100\t8\t9\t1\t9\t1\t9\t10\t12\t9M\n")).first()["nident"] == 8


def test_release(spark, tmp_path):
    path = put(tmp_path, "r.json", json.dumps([{"id": "x2", "sequence": "ACD", "databases": ["a", "b"]}, {"id": "x1", "sequence": "EFG", "databases": []}]))
    rows = readers.read_release(spark, path, manifest.file_sha256(path), 2)
    digest = writers.release_fasta(rows, str(tmp_path / "r.fasta"))
    assert (tmp_path / "r.fasta").read_text() == ">x1\nEFG\n>x2\nACD\n" and digest == manifest.file_sha256(str(tmp_path / "r.fasta"))
    writers.release_sources(rows, str(tmp_path / "sources"))
    for bad in ({"sha256": "0"}, {"count": 3}):
        with pytest.raises(ValueError):
            readers.read_release(spark, path, **bad)


def test_embeddings(spark, tmp_path):
    np.savez(tmp_path / "e.npz", sequences=np.array(["AC", "DE"]), embeddings=np.eye(2, dtype=np.float32), model=np.array("m"))
    rows = readers.read_npz_embeddings(spark, str(tmp_path / "e.npz"))
    assert {r["seq"]: r["embedding"] for r in rows.collect()} == {"AC": [1, 0], "DE": [0, 1]}
    with pytest.raises(ValueError):
        readers.read_npz_embeddings(spark, str(tmp_path / "e.npz"), spark.createDataFrame([("ZZ",)], "seq string"))
    calls = str(tmp_path / "calls")

    def embed(seqs):
        with open(calls, "a") as f:
            f.write("".join(s + "\n" for s in seqs))
        return np.array([[len(s)] for s in seqs], np.float32)

    cache = str(tmp_path / "cache")
    one = spark.createDataFrame([("A",), ("AC",), ("A",)], "seq string")
    assert readers.cached_embeddings(spark, cache, one, "m", embed).count() == 2
    assert readers.cached_embeddings(spark, cache, one.union(spark.createDataFrame([("ACD",)], "seq string")), "m", embed).count() == 3
    assert sorted(open(calls).read().split()) == ["A", "AC", "ACD"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("CC", 0.1 + 0.2), ("AA", 1 / 3)], "seq string, x double")
    writers.write_fasta(df, str(tmp_path / "f.fasta"))
    assert (tmp_path / "f.fasta").read_text() == ">p00000000\nAA\n>p00000001\nCC\n"
    writers.write_records(df, str(tmp_path / "g.fasta"), "s", 5)
    assert (tmp_path / "g.fasta").read_text().startswith(">s000000005\n")
    writers.write_fasta_folder(df, str(tmp_path / "folder"))
    assert {r["seq"] for r in readers.read_fasta(spark, str(tmp_path / "folder")).collect()} == {"AA", "CC"}
    writers.write_scores(df, str(tmp_path / "scores"), {"x": "value"})
    back = {r["sequence"]: r["value"] for r in spark.read.csv(str(tmp_path / "scores"), header=True, schema="sequence string, value double").collect()}
    assert back == {"CC": 0.1 + 0.2, "AA": 1 / 3}
    writers.write_table(df.withColumn("l", F.array("seq")), str(tmp_path / "t"), compression="gzip")
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 2
    writers.write_candidates(df.withColumn("proxy", F.lit(1.0)), str(tmp_path / "c"))
    writers.write_npz(df, str(tmp_path / "z.npz"), ["seq", "x"], "seq")
    assert np.load(tmp_path / "z.npz")["seq"].tolist() == ["AA", "CC"]
    assert writers.markdown_table(df.orderBy("seq")).splitlines()[2] == "| AA | 0.3333 |"
    with pytest.raises(ValueError):
        writers.write_json(str(tmp_path / "j.json"), {"x": float("nan")})


def test_publish_is_all_or_nothing(tmp_path):
    source, target = put(tmp_path, "a", "one"), str(tmp_path / "out")
    put(tmp_path, "out", "stale")
    with pytest.raises(ValueError):
        writers.publish({source: target}, {source: "0" * 64})
    assert not (tmp_path / "out").exists()
    writers.publish({source: target}, {source: manifest.file_sha256(source)})
    assert (tmp_path / "out").read_text() == "one"


def test_manifest(spark, tmp_path):
    manifest.pin(spark, str(tmp_path / "pins"), {"a": 1})
    manifest.pin(spark, str(tmp_path / "pins"), {"a": 1})
    with pytest.raises(ValueError, match="'a'"):
        manifest.pin(spark, str(tmp_path / "pins"), {"a": 2})
    with manifest.run_lock(str(tmp_path / "lock")), pytest.raises(RuntimeError), manifest.run_lock(str(tmp_path / "lock")):
        pass
    with pytest.raises(ValueError):
        manifest.check_files({"m.json": "0"}, str(tmp_path))
    calls = []

    def step(df):
        calls.append(1)
        return df.withColumn("y", F.col("id") * 2)

    rows = spark.range(10).withColumn("batch", F.col("id") % 3)
    for _ in range(2):
        assert manifest.resumable(str(tmp_path / "stamps"), rows, str(tmp_path / "out"), step, "v1").count() == 10
    assert len(calls) == 3
    for _ in range(2):
        assert manifest.stage(str(tmp_path / "stage"), {"v": 1}, lambda: step(rows), spark).count() == 10
    assert len(calls) == 4


def test_a_changed_part_runs_only_its_batch_again(spark, tmp_path):
    calls, out = [], tmp_path / "out"

    def step(df):
        calls.append(df.first()["batch"])
        return df.withColumn("y", F.col("id") * 2).repartition(2)

    rows = spark.range(12).withColumn("batch", F.col("id") % 3)
    run = lambda inputs="v1": sorted(tuple(r) for r in manifest.resumable(f"file://{tmp_path}/stamps", rows, f"file://{out}", step, inputs).select("id", "y").collect())
    want = [(k, 2 * k) for k in range(12)]
    assert run() == want and calls == [0, 1, 2]
    parts = lambda n: sorted((out / f"batch={n}").glob("part-*"))
    damaged = bytearray(parts(1)[0].read_bytes())
    damaged[len(damaged) // 2] ^= 1
    parts(1)[0].write_bytes(damaged)
    for crc in (out / "batch=1").glob(".part-*.crc"):
        crc.unlink()
    assert run() == want and calls[3:] == [1]
    parts(2)[0].unlink()
    assert run() == want and calls[4:] == [2]
    (out / "batch=0" / "part-99999-foreign.parquet").write_bytes(parts(2)[0].read_bytes())
    assert run() == want and calls[5:] == [0]
    assert run() == want and len(calls) == 6
    assert run("v2") == want and calls[6:] == [0, 1, 2]
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    whole = lambda v: sorted(r[0] for r in manifest.stage(str(tmp_path / "stage"), {"v": v}, build, spark).collect())
    assert whole(1) == whole(1) == [0, 1, 2, 3, 4] and len(built) == 1
    next((tmp_path / "stage").glob("part-*")).unlink()
    assert whole(1) == [0, 1, 2, 3, 4] and len(built) == 2 and whole(2) and len(built) == 3


def test_fasta_parts_read_as_one_file(spark, tmp_path):
    rng = np.random.default_rng(5)
    seqs = ["".join(rng.choice(list("ACDEFGHIKL"), rng.integers(8, 51))) for _ in range(3000)] + ["ACDEFGHI"] * 500
    df = spark.createDataFrame([(s,) for s in seqs], "seq string").repartition(5)
    writers.write_fasta(df, str(tmp_path / "one.fasta"), offset=7)
    writers.write_fasta_parts(df, f"file://{tmp_path}/parts", offset=7, partitions=6)
    parts = sorted((tmp_path / "parts").glob("part-*"))
    assert len(parts) > 3 and "".join(p.read_text() for p in parts) == (tmp_path / "one.fasta").read_text()
    back = readers.read_fasta(spark, f"file://{tmp_path}/parts")
    assert sorted(r["seq"] for r in back.collect()) == sorted(seqs) and back.select("header").distinct().count() == len(seqs)
    assert [r["record"] for r in readers.read_template_fasta(spark, f"file://{tmp_path}/parts").orderBy("record").limit(2).collect()] == [1, 2]


def test_fetch_tries_again_and_checks(tmp_path, monkeypatch):
    payload, calls = b">a\nACDE\n", []

    class Answer:
        def __init__(self, data):
            self.data = data

        def read(self):
            return self.data

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    def flaky(*_, **__):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no answer")
        return Answer(payload)

    digest = hashlib.sha256(payload).hexdigest()
    target = str(tmp_path / "f.fasta")
    for _ in range(2):
        readers.fetch("http://example.invalid/f", target, digest, opener=flaky)
    assert (tmp_path / "f.fasta").read_bytes() == payload and len(calls) == 3
    with pytest.raises(ValueError):
        readers.fetch("http://example.invalid/f", str(tmp_path / "g.fasta"), "0" * 64, opener=flaky)


def test_score_report(spark, tmp_path):
    path = put(tmp_path, "r.json", json.dumps([{"model": "a", "status": "ok"}, {"model": "b", "status": "ok"}, {"model": "c", "status": "failed"}]))
    assert readers.read_score_report(spark, path, ["a", "b"]).count() == 3
    for models in (["a", "c"], ["missing"]):
        with pytest.raises(ValueError):
            readers.read_score_report(spark, path, models)


def test_source_state(tmp_path):
    assert manifest.source_state(str(tmp_path)) == {}
    state = manifest.source_state("/root/repo")
    assert len(state.get("head", "0" * 40)) == 40


def test_accepted_pools(tmp_path):
    pool = put(tmp_path, "p.fasta", ">a\nAC\n")
    put(tmp_path, "p.json", json.dumps({"checkpoint": "c", "sha256": manifest.file_sha256(pool)}))
    put(tmp_path, "q.json", json.dumps({"checkpoint": "other"}))
    assert readers.accepted_pools(str(tmp_path / "*.json"), "c") == [pool]


def test_stream_counts_each_key_once(spark, tmp_path):
    for k, rows in enumerate([[("A", 1), ("B", 2)], [("B", 3), ("C", 4)]]):
        spark.createDataFrame(rows, "seq string, x int").write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = incremental.first_seen(incremental.candidate_stream(spark, str(tmp_path / "in"), "seq string, x int", 1), "seq")
        incremental.score_into(stream, lambda b: b.withColumn("n", F.length("seq")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["seq"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["A", "B", "C"]
