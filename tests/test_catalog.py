"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from millrace import catalog

SF = "/root/testdata/sf0.001"


def canonical(rows, names) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    with duckdb.connect() as db:
        for file in Path(SF).glob("*.parquet"):
            db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
        cursor = db.execute(catalog.SQL[name])
        names, rows = [d[0] for d in cursor.description], cursor.fetchall()
    assert sorted(got.columns) == sorted(names)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(rows, names)
