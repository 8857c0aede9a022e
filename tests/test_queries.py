"""Every core query against its SQL on the smallest tables; rows only where there is none."""

import math

import duckdb
import pytest

from firmlens.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", Q.QUERIES)
def test_query(spark, small, name):
    df = Q.QUERIES[name](spark, small)
    names = sorted(df.columns)
    got = sorted((tuple(norm(r[n]) for n in names) for r in df.collect()), key=repr)
    if name not in Q.SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    cur = con.execute(Q.SQL[name])
    at = [[d[0] for d in cur.description].index(n) for n in names]
    assert sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=repr) == got
