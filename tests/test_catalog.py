"""Every query with SQL gives the rows of its SQL statement."""

import decimal
import os

import duckdb
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.8g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    return tuple(map(norm, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


def names():
    from tapestride import plans

    return sorted(plans.oracle_sql())


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, duck, name):
    from tapestride import plans

    df = plans.queries()[name](spark, SF)
    rel = duck.execute(plans.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in rel.fetchall()), key=repr)
    got = sorted((tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr)
    assert got == want
