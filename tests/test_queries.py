"""Every query against its SQL, on the smallest tables."""

from numbers import Number
from pathlib import Path

import pandas as pd
import pytest

from terrafold.plans.catalogue import FLAGSHIP, QUERIES, SQL

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, Number) and not isinstance(v, bool) else str(v)

    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None)), key=str)


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, str(SF)).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and set(SQL) <= set(QUERIES)


def test_entry_lists_all():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
