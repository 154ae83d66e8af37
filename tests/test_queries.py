"""Every registered query of the core library against its SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from ledgerloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = db.sql(catalog.oracle_sql()[name])
    assert cols == sorted(want.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    assert got == sorted(repr(tuple(plain(r[want.columns.index(c)]) for c in cols)) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["j3_asof_join", "j4_asof_join_with_fallback"])
def test_every_transaction_looks_back(spark, name):
    """Each transaction asks, and an equal join on its date does not answer: those of few keys find older rows."""
    from ledgerloom.plans.base import tx

    rows = {r["key"]: r["v"] for r in catalog.queries()[name](spark, SF).collect()}
    t = tx(spark, SF).select("key", "suburb", "date", "price").collect()
    assert set(rows) == {r["key"] for r in t}
    on_day = {(r["suburb"], r["date"], r["price"]) for r in t}
    older = [r for r in t if rows[r["key"]] is not None and (r["suburb"], r["date"], rows[r["key"]]) not in on_day]
    assert len(older) > len(t) // 4
