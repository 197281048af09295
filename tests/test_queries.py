"""Every registered query of the engine runs; where there is SQL, DuckDB gives the same rows."""

import duckdb
import pytest

from pixelmill.plans.registry import ORACLES, QUERIES, flagship

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(map(tuple, df.astype(str).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_models_find_the_classes(spark, sf):
    from pixelmill.operators import labels as L
    from pixelmill.plans.queries import intensity_classes

    _, truth, _ = intensity_classes(spark, sf)
    for name, least in (("rf_segment", 0.55), ("gbt_segment", 0.5), ("logistic_segment", 0.4), ("train_and_apply", 0.4)):
        assert L.miou(QUERIES[name](spark, sf), truth).first()[0] > least, name


def test_flagship_plan_reads_one_column(spark, sf):
    plan = flagship(spark, sf)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan or "ReadSchema: struct<vec_id:" in plan
