"""Every query with an oracle gives the rows of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from lodestral.plans import more as catalog


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def _plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    cursor = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    expected = [repr([_plain(r[columns.index(c)]) for c in order]) for r in cursor.fetchall()]
    assert sorted(repr([_plain(r[c]) for c in order]) for r in df.collect()) == sorted(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
