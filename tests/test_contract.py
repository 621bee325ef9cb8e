"""Registered queries of this library against their SQL equivalents, in rows, values and column types.

The SQL of the slowest is left to the correctness run; set PROMPTSIEVE_ALL_QUERIES=1 to include it."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
ROWS_ONLY = {"q_train_score", "q_experiment", "q_explain", "q_model_importance", "q_stream_score"}
SLOW = {"q_tfidf_transform", "q_tfidf_char"}
OWN = {q for q in contract.queries() if q.startswith("q_")}
CHECKED = sorted(q for q in contract.oracle_sql() if q in OWN
                 and (os.environ.get("PROMPTSIEVE_ALL_QUERIES") or q not in SLOW))


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
         "HUGEINT": "bigint"}


def canonical(df):
    df = df[sorted(df.columns)].map(lambda v: "∅" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF_DIR):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{f}'")
    return con


def test_every_query_has_sql_or_a_reason():
    assert OWN - set(contract.oracle_sql()) == ROWS_ONLY
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert [r.label for r in contract.entry(spark).collect()] == [0, 1, 2]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, db, name):
    got, want = contract.queries()[name](spark, SF_DIR), db.sql(contract.oracle_sql()[name])
    kinds = {c: KINDS.get(str(t), str(t)) for c, t in zip(want.columns, want.types)}
    assert dict(got.dtypes) == kinds
    pd.testing.assert_frame_equal(canonical(got.toPandas()), canonical(want.df()))


def test_streams_read_tables_of_many_files(spark, tmp_path):
    """A table may be one file or a folder of files."""
    rows = [(i, f"payload {i % 30}") for i in range(90)]
    spark.createDataFrame(rows, "event_id bigint, props string").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    assert contract.queries()["q_stream_dedup"](spark, str(tmp_path)).count() == 30
