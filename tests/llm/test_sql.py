"""Registered queries of this part that have SQL, against it."""

import duckdb
import pytest

from winnowry.llm.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    cursor = con.execute(SQL[name])
    names = sorted(d[0] for d in cursor.description)
    want = [dict(zip((d[0] for d in cursor.description), r, strict=True)) for r in cursor.fetchall()]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == names
    shown = lambda rows: sorted(str([r[c] for c in names]) for r in rows)
    assert shown(r.asDict() for r in df.collect()) == shown(want)
