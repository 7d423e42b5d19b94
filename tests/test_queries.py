"""Every query with SQL against DuckDB, on the smallest tables; the others run and give rows."""

import math
import os

import __spark_entry__ as entry
import duckdb
import pytest
from outbreak_spark.kernels.trees import Booster
from outbreak_spark.operators import features, forecast
from outbreak_spark.plans.oracle import SQL
from outbreak_spark.plans.queries import ITERATIVE, QUERIES
from outbreak_spark.sources import tables

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def test_every_relational_query_has_sql():
    assert {f.__name__ for f in ITERATIVE} | set(SQL) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(norm(r[k]) for k in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["rt_credible", "incidence_interval", "seir_summary", "synthetic_epidemic", "multi_wave", "situation_reports"])
def test_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_forecasts_take_whole_series(spark, monkeypatch):
    seen, run = [], forecast.forecast
    monkeypatch.setattr(forecast, "forecast", lambda df, **k: seen.append(df) or run(df, **k))
    for name in ("forecasts", "ensemble_forecast"):
        QUERIES[name](spark, DATA)
    days = tables.from_shipments(spark, DATA).count()
    assert days > 5 * 200 and [x.count() for x in seen] == [days, days]


def test_drivers_are_of_the_full_model(spark):
    rows = features.lag_features(tables.from_events(spark, DATA)).orderBy("record_index").toPandas()
    got = QUERIES["shap_drivers"](spark, DATA).orderBy("rank").toPandas()
    assert len(got)
    for key, top in list(got.groupby(["region", "pathogen"]))[:3]:
        own = rows[(rows.region == key[0]) & (rows.pathogen == key[1])]
        x = own[features.feature_names()].to_numpy(float)
        model = Booster(trees=200, depth=6, rate=0.1, rows=1.0, features=1.0, least=1).fit(x, own.target.to_numpy(float))
        want = dict(zip(features.feature_names(), abs(model.shapley(x)).mean(0), strict=True))
        assert all(abs(want[f] - v) < 1e-4 for f, v in zip(top.feature, top.importance, strict=True))
