import math

import duckdb
import pytest

from lexspan import catalogue, catalogue_contracts, catalogue_orders, catalogue_volume, catalogue_zh  # noqa: F401

SF = "/root/testdata/sf0.01"
TABLES = ["documents", "embeddings", "pages", "labels", "conversations", "events", "benchmark", "orders", "lineitem", "customer", "nation"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda x: "null" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.6f}" if isinstance(x, float) else str(x)
    return [columns[i] for i in order], sorted(tuple(tidy(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in catalogue.ORACLE_SQL:
        cur = duck.execute(catalogue.ORACLE_SQL[name])
        want = rows([d[0] for d in cur.description], cur.fetchall())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        assert got[1] == want[1]
    else:
        assert got[1]
