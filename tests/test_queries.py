"""Every query of the engine against its SQL, and the entry point."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from chronolane import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    one = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    found = registry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    want = duck.execute(registry.oracle_sql()[name])
    at = {d[0]: k for k, d in enumerate(want.description)}
    assert sorted(at) == columns
    assert plain(tuple(r[c] for c in columns) for r in found.collect()) == plain(tuple(r[at[c]] for c in columns) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_has_rows(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() == 5
    assert set(registry.queries()) <= set(entry_point.queries())


def test_registering_needs_no_session():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], check=True, timeout=120)
