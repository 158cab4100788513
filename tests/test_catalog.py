"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from keylode.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([None if r[i] is None else r[i] for i in at]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = df.collect()
    assert got
    if name in catalog.ORACLE_SQL:
        r = duck.execute(catalog.ORACLE_SQL[name])
        columns = [c[0] for c in r.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows_of(df.columns, got) == rows_of(columns, r.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("rows", [900, 9000])
def test_positions_follow_the_log(spark, tmp_path, rows):
    made = spark.range(rows).selectExpr("id AS event_id", "id * 7 % 45 AS user_id", "if(id % 11 = 0, 'error', 'view') AS event_type", "concat('p', id) AS props")
    made.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name, column, least, most in (("as_of_middle", "seq", 0.45, 0.5), ("apply_majority", "log_index", 0.9, 1)):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        got = df.collect()
        r = con.execute(catalog.ORACLE_SQL[name])
        assert rows_of(df.columns, got) == rows_of([c[0] for c in r.description], r.fetchall())
        assert least * rows <= max(r[column] for r in got) < most * rows
        assert name == "as_of_middle" or len(got) >= least * rows
