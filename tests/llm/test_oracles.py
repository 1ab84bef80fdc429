"""Training-data queries against their SQL."""

import duckdb
import pytest

from cohortarium.llm import queries

from .conftest import DATA


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.execute(queries.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(found.description)}
    assert sorted(at) == columns
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[at[c]] for c in columns) for r in found.fetchall())
