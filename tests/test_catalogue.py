"""Every query of the catalogue against its DuckDB SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from conftest import SMALL

from loomline.plans.catalogue import ORACLE_SQL, QUERIES


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        return "" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLE_SQL:
        assert rows(found) == rows(duck.execute(ORACLE_SQL[name]).df())
    else:
        assert len(found)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
