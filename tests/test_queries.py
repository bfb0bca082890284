"""Every query against its SQL in DuckDB, over the same tables."""

import math
import os

import duckdb
import pytest

from ionsift.plans.queries import ORACLE_SQL, QUERIES

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"create view {t} as select * from read_parquet('{os.path.join(data, t)}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, int)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8) + 0.0
    if hasattr(v, "is_finite"):
        return round(float(v), 8)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(r[i]) for i in order] for r in records), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    found = rows(df.columns, df.collect())
    if name in ORACLE_SQL:
        cur = duck.execute(ORACLE_SQL[name])
        assert found == rows([c[0] for c in cur.description], cur.fetchall())
    else:
        assert found[1]


@pytest.mark.parametrize("name", ["mass_window_topk", "knn_deterministic", "tanimoto_topk", "consensus_search", "semi_join_nearest_target"])
def test_no_all_pairs_plan(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
