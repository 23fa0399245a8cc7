"""Every registered query of the array engine against its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from lattica.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name, tmp_path):
    found = catalog.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(found.columns))
    found.write.parquet(str(tmp_path / "out"))
    value = lambda sql: duck.execute(sql).fetchall()[0][0]
    duck.execute(f"CREATE OR REPLACE TEMP TABLE a AS SELECT {columns} FROM '{tmp_path}/out/*.parquet'")
    duck.execute(f"CREATE OR REPLACE TEMP TABLE b AS SELECT {columns} FROM ({catalog.ORACLE_SQL[name]})")
    assert value("SELECT count(*) FROM a") == value("SELECT count(*) FROM b")
    assert value("SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)") == 0
