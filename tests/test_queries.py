"""Every registered query against its SQL in DuckDB."""

import duckdb
import pytest

from winnowry.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


def canonical(rows):
    shown = [tuple(repr(v) if isinstance(v, (float, bool)) or v is None else str(v) for v in r) for r in rows]
    return sorted(shown)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [[r[c] for c in columns] for r in df.collect()]
    assert name in SQL, "every query has SQL to compare with"
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    wanted = [[r[names.index(c)] for c in columns] for r in cursor.fetchall()]
    assert canonical(got) == canonical(wanted)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
