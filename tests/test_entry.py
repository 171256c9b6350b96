import duckdb
import pytest

import __spark_entry__
from concord.plans.queries import ORACLE, QUERIES
from concord.plans.views import TABLES

FOLDER = "/root/testdata/sf0.001"


def told(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    shown = lambda v: "%.9g" % v if isinstance(v, float) else str(v)
    return [columns[k] for k in order], sorted(tuple(shown(float(r[k]) if type(r[k]).__name__ == "Decimal" else r[k]) for k in order) for r in rows)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name in ORACLE:
        got = duck.execute(ORACLE[name])
        assert told([tuple(r) for r in rows], df.columns) == told(got.fetchall(), [d[0] for d in got.description])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
