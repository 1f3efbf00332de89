import glob

import pytest

from sourcegrain.llm import queries as llm_queries

duckdb = pytest.importorskip("duckdb")


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in llm_queries.queries()) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM read_parquet('{path}')")
    result = con.execute(llm_queries.oracle_sql()[name])
    df = llm_queries.queries()[name](spark, sf_dir)
    names = [c[0] for c in result.description]
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, result.fetchall()))
