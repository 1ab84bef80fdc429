"""Every registered cohort query against its SQL."""

import duckdb
import pytest

from cohortarium.plans import attribute_queries, queries  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat()[:10] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.execute(queries.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(found.description)}
    assert sorted(at) == columns
    theirs = sorted((tuple(plain(r[at[c]]) for c in columns) for r in found.fetchall()), key=str)
    assert ours == theirs and ours


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 72
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_training_data(tmp_path):
    """With the training-data folders gone, the rest still imports and registers."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "cohortarium", tmp_path / "cohortarium", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split() == [str(len(queries.QUERIES)), "False"]
