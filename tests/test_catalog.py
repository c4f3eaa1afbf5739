"""Every query of the catalog against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from clausewise.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def shown(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_oracle(spark, sql, name):
    got = catalog.QUERIES[name](spark, SF)
    want = sql.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [[shown(r[c]) for c in columns] for r in got.collect()]
    place = [want.columns.index(c) for c in columns]
    assert sorted(rows) == sorted([shown(r[k]) for k in place] for r in want.fetchall())
    assert rows


def test_every_query_has_a_name_of_its_own():
    assert len(catalog.QUERIES) == sum(len(p.QUERIES) for p in catalog.PARTS)
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry_runs_without_the_optional_parts(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert os.path.basename(__spark_entry__.__file__) == "__spark_entry__.py"
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
