"""Every registered query of the paged-document operators against its SQL in DuckDB."""

import math

import duckdb
import pytest

from pagefold import catalog, merge_catalog  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def normal(rows):
    plain = lambda v: "inf" if isinstance(v, float) and math.isinf(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    told = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(told.columns) == columns
    at = [told.columns.index(c) for c in columns]
    assert normal(df.select(columns).collect()) == normal(tuple(r[i] for i in at) for r in told.fetchall())
