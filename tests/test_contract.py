"""The registered queries against their SQL on the smallest data."""

import math
import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"


def norm(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_core_queries(spark):
    from lectern.plans import oracles, queries, upkeep, upkeep_sql

    sql, known = {**oracles.ORACLES, **upkeep_sql.UPKEEP}, {**queries.QUERIES, **upkeep.QUERIES}
    assert set(sql) <= set(known)
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    for name in sorted(sql):
        df = known[name](spark, DATA)
        cols = sorted(df.columns)
        mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
        out = con.execute(sql[name])
        names = [d[0] for d in out.description]
        theirs = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in out.fetchall()), key=str)
        assert mine == theirs, name


def test_core_stands_alone():
    """No module of the core imports the training-text package."""
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "lectern")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "lectern.llm" not in open(os.path.join(folder, f)).read(), f
