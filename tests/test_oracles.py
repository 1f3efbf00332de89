"""Each registered query of the engine's own operators against its SQL."""

import glob

import pytest

from sourcegrain.plans import registry

duckdb = pytest.importorskip("duckdb")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, tables, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    result = tables.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(result.fetchall(), names)
