"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math

import pytest

from attestra.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or str(v) in ("<NA>", "NaT", "nan"):
        return None
    if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
        return bool(v)
    try:
        return round(float(v), 5) if not isinstance(v, str) and math.isfinite(float(v)) else v
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(([plain(v) for v in r] for r in df.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name not in registry.ORACLE_SQL:
        assert name == "fn10_dct_hash"  # held against a plain loop in test_operators
        return
    expected = duck.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
