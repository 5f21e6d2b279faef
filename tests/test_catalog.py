import duckdb
import pytest

from tidewater.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = ("orders", "customer", "nation", "events", "documents", "conversations")


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DIR)
    want = db.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == _rows(want.columns, want.fetchall())
    assert got or name == "next_baseline"


@pytest.mark.parametrize("name", ["smtp_plan", "header_addresses", "header_fields", "strip_bcc", "smtp_data", "envelope_sender"])
def test_messages_of_a_small_file_are_dealt(spark, monkeypatch, name):
    assert catalog.QUERIES[name](spark, DIR).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # before, one task for one small file
    from tidewater import shared

    monkeypatch.setattr(shared, "TEXT_ROWS", 10, raising=False)
    assert catalog.QUERIES[name](spark, DIR).rdd.getNumPartitions() == 15


def test_a_submission_takes_its_header_apart_once(spark):
    plan = catalog.QUERIES["smtp_plan"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("arrays_zip(") == 1  # before, three times
