"""Every registered query against its DuckDB oracle on the smallest tables.

Same comparison as the driver: sorted column names, row count, and an
order-insensitive hash of the values (doubles rounded to 6 places); the
column types must also be the same on both sides.
"""

import hashlib
import math

import pytest

from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(hashlib.sha1("\x1f".join(_norm(r[i]) for i in order).encode()).hexdigest() for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _names():
    from sourcelens.plans import catalog
    return sorted(catalog.ORACLE)


def test_every_query_has_an_oracle():
    from sourcelens.plans import catalog
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


@pytest.mark.parametrize("name", _names())
def test_matches_oracle(spark, duck, name):
    from sourcelens.plans import catalog
    df = catalog.QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.execute(catalog.ORACLE[name])
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)
    spark_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    duck_types = {r[0]: r[1] for r in duck.execute("DESCRIBE " + catalog.ORACLE[name]).fetchall()}
    assert spark_types == duck_types
