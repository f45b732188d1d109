"""Names of the registered queries, and those that SQL can express."""

import glob
import os

import pytest

from helixscan.llm import registry

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_what_sql_gives(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df, relation = registry.QUERIES[name](spark, SF), db.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    key = lambda row: tuple(map(repr, row))
    want = [tuple(r[list(relation.columns).index(c)] for c in columns) for r in relation.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted(want, key=key)
