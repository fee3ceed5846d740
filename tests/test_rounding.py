"""Rounded numbers are those of the SQL to the last bit: zeros keep their signs."""

import duckdb
import numpy as np
import pytest

from tessera import plans

#: By finding.
NAMES = ["add_new_prints", "audio_cut", "audio_cut_chunked", "chunk_padded", "concatenated", "down_mix", "l2_norm", "mean_removed"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """Vectors of small numbers of both signs, with zeros of both and halves of the last digit."""
    r = np.random.default_rng(8)
    v = r.choice([-1e-6, 1e-6, -0.0, 0.0, -4e-6, 5e-6, -5e-6, 0.015625, -0.015625, 0.3, -0.7], (40, 64)) * r.choice([1.0, 0.5], (40, 64))
    v[:, ::9] = -1e-6
    at = tmp_path_factory.mktemp("small")
    rows = ", ".join(f"({k}, {x.tolist()}::FLOAT[], {k % 10}::INTEGER)" for k, x in enumerate(v))
    duckdb.sql(f"COPY (SELECT vec_id::BIGINT AS vec_id, embedding, label FROM (VALUES {rows}) AS t(vec_id, embedding, label)) TO '{at}/embeddings.parquet' (FORMAT parquet)")
    return str(at)


@pytest.mark.parametrize("name", NAMES)
def test_rounded_as_in_sql(spark, tables, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tables}/embeddings.parquet'")
    want = con.execute(plans.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    want = sorted(repr(r) for r in want.fetchall())
    got = [tuple(r[n] for n in names) for r in plans.QUERIES[name](spark, tables).collect()]
    assert sum("-0.0," in w or "-0.0]" in w for w in want)
    assert sorted(map(repr, got)) == want
