"""Every registered query against its check SQL on the smallest data, and no plan with a pair-forming join."""
import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from dossierflow.tables import TABLE_NAMES

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def canon(v):
    if v is None:
        return "∅"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.6g}" if abs(v) < 10**6 else str(v)
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLE_NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    cols = sorted(df.columns)
    rows = sorted("|".join(canon(r[c]) for c in cols) for r in df.select(*cols).collect())
    if name not in SQL:
        return
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == cols
    assert rows == sorted("|".join(canon(r[i]) for i in order) for r in cur.fetchall())
