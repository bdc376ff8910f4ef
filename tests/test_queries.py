"""Every query with SQL against that SQL, and the others by what they must satisfy."""

import os

import duckdb
import pandas as pd
import pytest

from locusframe.plans import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_rows(spark, db, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), db.sql(Q.ORACLE[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda x: x[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE)))
def test_others_run(spark, name):
    assert Q.QUERIES[name](spark, SF).count() >= 0


def test_pca(spark):
    p = Q.QUERIES["pca"](spark, SF).toPandas()
    assert p.groupby("axis").percent.nunique().eq(1).all() and p.groupby("axis").percent.first().is_monotonic_decreasing


def test_mantel(spark):
    row = Q.QUERIES["mantel"](spark, SF).first()
    want = Q.QUERIES["distance_geo_corr"](spark, SF).first()["r"]
    assert 0 < row["p"] <= 1 and row["r"] == pytest.approx(want, abs=1e-5)


def test_geodesic_is_near_the_sphere(spark):
    a = Q.QUERIES["geodesic"](spark, SF).toPandas().set_index(["a", "b"]).km
    b = Q.QUERIES["great_circle"](spark, SF).toPandas().set_index(["a", "b"]).km
    assert ((a / b - 1).abs().dropna() < 0.01).all()


def test_filters_in_turn(spark):
    for name in ("iterative_filter", "strict_filter"):
        rows = Q.QUERIES[name](spark, SF).toPandas()
        assert rows.site_id.is_unique
        assert (rows.n_called <= rows.n_samples).all()
