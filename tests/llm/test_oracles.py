"""The training-data queries against their SQL on the smallest tables."""

import duckdb
import pytest

from lodestone.llm import entry
from lodestone.queries import TABLES
from tests.test_queries import plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = con.execute(entry.ORACLES[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    assert got == sorted((tuple(plain(r[theirs.index(c)]) for c in columns) for r in cursor.fetchall()), key=str)
