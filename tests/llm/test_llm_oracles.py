"""Queries of the subpackage that have SQL."""

from pathlib import Path

import duckdb
import pytest

from lodestral.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, data, name):
    c = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, data)
    cursor = c.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(x) for x in df.columns]
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[k] for k in order) for r in cursor.fetchall())
