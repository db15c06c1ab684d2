"""Every query with SQL against DuckDB on the smallest tables."""

import os
import re

import duckdb
import pytest

from tessera.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings docs nodes chunks extracted_pages page_provenance eval_queries hybrid_rows scorers removals".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, values):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([round(v[i], 6) if isinstance(v[i], float) else v[i] for i in at]) for v in values)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    want = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = rows(columns, want.fetchall())
    assert [re.sub(r"\.0\b", "", x) for x in got] == [re.sub(r"\.0\b", "", x) for x in want]


@pytest.mark.parametrize("name", ["parsed_chunks", "parsed_blocks", "p1_hierarchy"])
def test_runs_without_sql(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
