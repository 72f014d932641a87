"""Every query with SQL gives DuckDB's rows on the smallest tables; the others run."""

import glob
import math
import os

import duckdb
import pytest

from strandline import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert got
    sql = queries.ORACLE_SQL.get(name)
    if not sql:
        return
    rel = duck.sql(sql)
    want = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    a, b = rows(df.columns, got), rows(rel.columns, want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == y or all(p == q or isinstance(p, (float, tuple)) and close(p, q) for p, q in zip(x, y, strict=True)), (x, y)


def close(p, q):
    if isinstance(p, tuple):
        return len(p) == len(q) and all(close(a, b) for a, b in zip(p, q, strict=True))
    return p is not None and q is not None and abs(p - q) <= 2e-5


def exact(spark, tmp_path, name, vectors):
    """A query's rows over the given vectors, and its SQL's, as text: signs of zeros count."""
    rows = [(8 * k, v, k % 3) for k, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    rel = con.sql(queries.ORACLE_SQL[name])
    by = sorted(got.columns)
    return sorted(repr([r[c] for c in by]) for r in got.collect()), sorted(repr([r[rel.columns.index(c)] for c in by]) for r in rel.fetchall())


#: Values that round to zero from below, zeros of both signs, ties and values without a fraction.
TINY = [[s * v for v in row] for s in (1.0, -1.0) for row in ([0.5, 3e-7, 0.0] + [0.125] * 61, [1e-9] * 64, [0.0] * 64, [0.0078125, 5e-7, 1e30] + [1.5] * 61)]


@pytest.mark.parametrize("name", ["l2_normalize", "layer_norm", "pad_or_trim", "masked_mean"])
def test_signs_of_zero(spark, tmp_path, name):
    got, want = exact(spark, tmp_path, name, TINY)
    assert got == want
    assert name == "layer_norm" or any("-0.0," in r for r in got)
