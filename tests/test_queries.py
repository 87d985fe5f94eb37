import inspect
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from seqloom.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
HEAVY = {"similarity_edges", "crowding_fraction", "too_similar", "novelty_block"}


def plain(df):
    df = df[sorted(df.columns)]
    for c in df.columns:
        df = df.assign(**{c: df[c].map(lambda v: str(float(v)) if isinstance(v, (float, np.floating)) else str(v))})
    return sorted(map(tuple, df.to_numpy().tolist()))


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLES) - HEAVY))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got, expected = catalogue.QUERIES[name](spark, D).toPandas(), con.execute(catalogue.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and len({r["seq"] for r in rows}) == len(rows)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_searches_have_full_budgets(spark, monkeypatch):
    seen = {}

    def watch(module, name):
        f = getattr(module, name)

        def call(*args, **more):
            bound = inspect.signature(f).bind(*args, **more)
            bound.apply_defaults()
            seen.setdefault(name, []).append(bound.arguments)
            return f(*args, **more)

        monkeypatch.setattr(module, name, call)

    for name in ("guarded_swaps", "repair_neighbors", "repair_zero_edge", "exchange"):
        watch(catalogue.selection, name)
    watch(catalogue.reports, "embedding_metrics")
    for q in ("guarded_swap", "neighbor_repair", "zero_edge_repair", "exchange_refine", "embedding_metrics"):
        catalogue.QUERIES[q](spark, D)
    assert [x["rounds"] for x in seen["guarded_swaps"]] == [2000, 2000]
    assert [x["budget"] for k in ("repair_neighbors", "repair_zero_edge") for x in seen[k]] == [3000, 3000]
    assert [x["epochs"] for x in seen["exchange"]] == [60] and [x["n"] for x in seen["embedding_metrics"]] == [1000]
    assert seen["guarded_swaps"][0]["features"].shape[1] == 128 + 33 * 4
