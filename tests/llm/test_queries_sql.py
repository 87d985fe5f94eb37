import os

import duckdb
import numpy as np
import pytest

from seqloom.llm import queries

from ..test_queries import TABLES, D, plain


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got, expected = queries.QUERIES[name](spark, D).toPandas(), con.execute(queries.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) and plain(got) == plain(expected)


def test_vectors_with_links_match_sql(spark, tmp_path):
    """The given small tables hold no pair at the threshold; this one has chains, copies and near misses of it."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 64))
    rows = [v for v in base] + [v + rng.normal(size=64) * s for v in base for s in (0.05, 0.2, 0.3, 0.35)] + [base[0], -base[1], np.zeros(64)]
    rows += [rows[-5] + rng.normal(size=64) * 0.2 * k for k in range(4)]
    order = rng.permutation(len(rows))
    table = spark.createDataFrame([(int(i), [float(x) for x in rows[k].astype(np.float32)], 0) for i, k in enumerate(order)], "vec_id long, embedding array<float>, label int")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got, expected = queries.QUERIES["op6_embeddings"](spark, str(tmp_path)).toPandas(), con.execute(queries.ORACLES["op6_embeddings"]).fetchdf()
    assert plain(got) == plain(expected) and got["n_links"].sum() > 200 and not got["kept"].all()
