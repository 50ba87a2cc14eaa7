"""Every query with SQL gives the same rows as DuckDB on the given tables."""

import os

import duckdb
import pytest

from textledger import queries as ledger

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ledger.ORACLES))
def test_same_rows(spark, duck, name):
    df = ledger.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    found = duck.execute(ledger.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    theirs = sorted(str([plain(r[names.index(c)]) for c in cols]) for r in found.fetchall())
    assert ours == theirs


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(ledger.QUERIES) <= set(entry.queries())
    assert set(ledger.ORACLES) <= set(entry.oracle_sql())
