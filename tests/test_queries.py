"""Every registered query of the engine against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from millrace.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def plain(frame: pd.DataFrame) -> list[tuple]:
    def one(v):
        if not hasattr(v, "__len__") and pd.isna(v):
            return ""
        return repr(float(v) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    found = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.SQL:
        wanted = db.sql(catalogue.SQL[name]).df()
        assert sorted(found.columns) == sorted(wanted.columns)
        assert plain(found) == plain(wanted)
    else:
        assert len(found.columns)
