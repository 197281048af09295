"""Queries against their SQL at the smallest scale."""

import duckdb
import pytest

from pixelmill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    out = QUERIES[name](spark, sf)
    q = c.execute(ORACLES[name])
    names = [x[0] for x in q.description]
    want = q.fetchall()
    assert sorted(out.columns) == sorted(names)
    assert sorted(map(tuple, out.select(*names).collect()), key=str) == sorted(want, key=str)
