"""Every registered query of the catalogue against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from sievegate import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, columns):
    tidy = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(tidy(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    rows = [r.asDict() for r in df.collect()]
    if name not in catalog.oracle_sql():
        assert df.columns
        return
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    assert plain(rows, columns) == plain([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)
