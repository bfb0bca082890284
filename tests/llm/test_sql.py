"""The queries with SQL against DuckDB: on the tables of the tests, with nulls and ties, and on the edge cases."""

import collections

import duckdb
import pytest

from ionsift.llm import queries


def bag(rows):
    return collections.Counter(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("which", ["edges", "repeats", "tables"])
def test_sql(spark, data, folder, repeats, name, which):
    at = {"edges": folder, "repeats": repeats, "tables": data}[which]
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        rows = spark.read.parquet(f"{at}/{t}.parquet").toArrow()  # noqa: F841
        con.execute(f"create table {t} as select * from rows")
    df = queries.QUERIES[name](spark, at)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert bag(df.select(*names).collect()) == bag(cur.fetchall())
