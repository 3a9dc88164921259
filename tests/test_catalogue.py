"""Every query of the reference's own operators agrees with its SQL."""

from __future__ import annotations

import decimal

import duckdb
import pytest

from graphloom.plans import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return v if v is None or isinstance(v, bool | int) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_agrees_with_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(v) for v in row]) for row in df.select(*columns).collect())
    told = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(repr([plain(row[i]) for i in at]) for row in told.fetchall())


def test_pathways_walk_breadth_first(spark):
    from graphloom.operators.traversal import pathways

    edges = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (2, 4, 0.7), (3, 4, 0.9), (4, 1, 1.0), (4, 5, 0.5)], "src long, dst long, confidence double")
    rows = sorted(pathways(edges, spark.createDataFrame([(1,)], "id long")).collect(), key=lambda r: r.step)
    assert [(r.step, r.id, r.depth) for r in rows] == [(1, 1, 0), (2, 2, 1), (3, 3, 1), (4, 4, 2), (5, 5, 3)]


def test_components_of_a_long_path(spark):
    from graphloom.operators.components import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "src long, dst long")
    labels = {r.id: r.component for r in connected_components(edges).collect()}
    assert set(labels.values()) == {0, 900} and labels[200] == 0 and labels[901] == 900
    assert connected_components(edges.limit(0)).count() == 0
