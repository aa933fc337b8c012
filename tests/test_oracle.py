"""Every query over reads against DuckDB's result of the same SQL."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
if not os.path.isdir(FOLDER):
    pytest.skip("no tables", allow_module_level=True)

from strandloom import file_queries  # noqa: E402, F401  registers its queries
from strandloom.queries import ORACLE, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("lineitem", "customer"):
        c.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted(str([r[c] for c in columns]) for r in got.collect())
    if name not in ORACLE:
        assert rows
        return
    found = db.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(str([r[k] for k in order]) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
