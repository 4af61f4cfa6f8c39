"""Every query with SQL, against DuckDB on the smallest tables; the others run."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from wayfront.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def value(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, (float,)) or type(v).__name__.startswith("float"):
            return f"{float(v):.8g}"
        return str(v.item() if hasattr(v, "item") else v)

    return sorted(tuple("1" if (x := value(v)) == "True" else "0" if x == "False" else x for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    found = catalog.QUERIES[name](spark, sf_dir).toArrow().to_pandas()
    if name not in catalog.ORACLES:
        assert len(found)
        return
    expected = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert plain(found) == plain(expected)
