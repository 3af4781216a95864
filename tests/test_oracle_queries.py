"""Every registered query against its DuckDB statement on the smallest
tables (the driver runs the same comparison at sf 0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from check_oracle import rows_of
from conftest import SF_SMALL
from flowsieve.sources.tables import TABLES

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_oracle_key_is_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, key):
    got = QUERIES[key](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLE[key]).df()
    gc, gr = rows_of(got)
    wc, wr = rows_of(want)
    assert gc == wc
    assert len(gr) == len(wr)
    assert gr == wr


@pytest.mark.parametrize("key,rows", [("rf_importance", 17), ("pca_components", 17),
                                      ("feature_report", 17), ("train_score_eval", 4)])
def test_model_queries_shape(spark, key, rows):
    assert QUERIES[key](spark, SF_SMALL).count() == rows


def test_loss_curve_decreases(spark):
    pdf = QUERIES["loss_curve"](spark, SF_SMALL).toPandas()
    assert len(pdf) > 1 and pdf["loss"].iloc[-1] < pdf["loss"].iloc[0]


def test_row_preserving_model_queries(spark):
    n = QUERIES["flow_ratios"](spark, SF_SMALL).count()
    assert QUERIES["anomaly_scores"](spark, SF_SMALL).count() == n
    assert QUERIES["stream_scoring"](spark, SF_SMALL).count() == n
    eng = QUERIES["engineer_all"](spark, SF_SMALL)
    assert eng.count() == n and len(eng.columns) > 100


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == E.entry(spark).columns
