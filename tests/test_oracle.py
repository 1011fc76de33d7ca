"""Every registered query that has SQL, against DuckDB at sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    rel = duck.execute(entry.oracle_sql()[name])
    cols = sorted(d[0] for d in rel.description)
    names = [d[0] for d in rel.description]
    assert cols == sorted(got.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    zero = lambda v: 0.0 if isinstance(v, float) and v == 0 else v
    want = sorted((tuple(zero(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=key)
    have = sorted((tuple(zero(r[c]) for c in cols) for r in got.collect()), key=key)
    assert len(have) == len(want) > 0
    assert have == want


def test_entry(spark):
    assert entry.entry(spark).count() == 63 * 17 * 64
