"""Columns of the operators that SQL can express, against that SQL."""

import os

import pytest

from helixscan.llm import base

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n ", None), (4, "a b c a b c a b c", "en"), (5, "a b c a b c a b c", "en"), (6, "x\nx\n\nx\r\ny ## $|<", "en"),
    (7, "Mail a.b+c@d-e.org.x, a@b and @@x@y.z; 1.2.3.4 256.1.1.1 001.2.3.255 1.2.3.4.5.6.7.8", "de"),
    (8, "4111 1111 1111 1111 and 4111-1111-1111-1112, 5500005555555559; 1234567890123; 0000000000000", None), (11, "5500005555555559 1234567890123", None),
    (9, "+1 (202) 555-0143, +49.30.123456, +1 2 3 and ++44 20 7946 0958 é +33 1 23 45 67 89", "fr"), (10, "é ß 　x ÀÀ a@b.c é" + " word" * 60, "fr"), (20, "one two three " * 4000, "en"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = spark.createDataFrame([*ODD, ODD[6]], "doc_id long, text string, lang string")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return folder


def compare(spark, folder, name):
    db = duckdb.connect()
    path = f"{folder}/documents.parquet"
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df, relation = base.QUERIES[name](spark, folder), db.sql(base.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    key = lambda row: tuple(map(repr, row))
    want = sorted((tuple(r[list(relation.columns).index(c)] for c in columns) for r in relation.fetchall()), key=key)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert got == want
    return [dict(zip(columns, r, strict=True)) for r in got]


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_columns_give_what_sql_gives(spark, name):
    assert compare(spark, SF, name)


@pytest.mark.parametrize("name", sorted(base.QUERIES))
def test_odd_rows_give_what_sql_gives(spark, odd, name):
    rows = compare(spark, odd, name)
    assert len(rows) == len(ODD) + 1
    if name == "pii_base":
        of = {r["doc_id"]: r for r in rows}
        assert [of[7]["n_email"], of[7]["n_ip"], of[8]["n_card"], of[11]["n_card"], of[9]["n_phone"]] == [2, 4, 3, 0, 4]
