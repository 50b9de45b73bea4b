"""The queries that SQL can express, against it, on the smallest tables."""

from __future__ import annotations

import pytest

from millrace.llm import entry
from tests.test_catalog import SF, canonical


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    got = entry.queries()[name](spark, SF)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        cursor = db.execute(entry.oracle_sql()[name])
        names, rows = [d[0] for d in cursor.description], cursor.fetchall()
    assert sorted(got.columns) == sorted(names)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(rows, names)
