"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from tessera import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_against_sql(spark, duck, tmp_path, name):
    catalog.QUERIES[name](spark, FOLDER).write.parquet(f"{tmp_path}/out")
    duck.execute(f"CREATE OR REPLACE TEMP TABLE want AS {catalog.ORACLE_SQL[name]}")
    duck.execute(f"CREATE OR REPLACE TEMP TABLE got AS SELECT * FROM read_parquet('{tmp_path}/out/*.parquet')")
    names = [sorted(r[0] for r in duck.execute(f"DESCRIBE {t}").fetchall()) for t in ("want", "got")]
    assert names[0] == names[1]
    columns = ", ".join(f'"{c}"' for c in names[0])
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 5").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0
