"""Every registered query of the core: equal to its DuckDB twin, or at least well formed."""

import numbers

import duckdb
import pandas as pd
import pytest

from lexmill.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if pd.api.types.is_scalar(v) and pd.isna(v):
            return ""
        return f"{v:.6f}" if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in queries.ORACLES:
        want = duck.execute(queries.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry_registers_what_the_core_has():
    import __spark_entry__ as entry

    assert len(queries.QUERIES) >= 73 and len(queries.ORACLES) >= 64  # none is ever dropped
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
