"""Every order is a query row of the place queries: held against brute force on small tables."""

from collections import Counter

import pytest

from geoloom import catalog

QUERIES = catalog.queries()
#: (o_orderkey, o_custkey): keys of every remainder by 4, 5 and 7.
ORDERS = [(k, k * 13 % 50) for k in range(1, 141)]
CUSTOMERS = range(1, 120)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("places")
    spark.createDataFrame(ORDERS, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame([(k, k % 2, 1.0) for k in CUSTOMERS], "c_custkey bigint, c_nationkey bigint, c_acctbal double").write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame([(0, "INDIA"), (1, "PERU")], "n_nationkey bigint, n_name string").write.parquet(f"{path}/nation.parquet")
    return str(path)


def _rows(spark, name, path, *columns):
    return sorted(tuple(r[c] for c in columns) for r in QUERIES[name](spark, path).collect())


def _name(c, spread):
    return f"block {c // spread}" + ("", " society", " gate")[c % spread % 3]


def test_geocode_takes_all_orders(spark, tables):
    want = []
    for k, cust in ORDERS:
        hits = [c for c in CUSTOMERS if _name(c, 2) == f"block {cust % 900}" and (k % 2 or c // 2 % 9 == cust % 9)]
        want.append((k, "resolved" if len(hits) == 1 else "ambiguous" if hits else "missing"))
    assert _rows(spark, "join14_geocode", tables, "query_id", "status") == want


def test_lookup_takes_all_orders(spark, tables):
    want = []
    for k, cust in ORDERS:
        if k % 3 == 0:
            want.append((k, "cached", "osm-lookup-cache"))
        elif cust in CUSTOMERS:
            want.append((k, f"p{cust:07d}", "local-serp-cache" if cust % 4 == 0 else "local-osm-cache"))
    assert _rows(spark, "set2_lookup", tables, "query_id", "place_id", "stage") == sorted(want)


def test_table_join_takes_all_orders(spark, tables):
    hits = [(k, f"p{c:07d}", 1000.0 + cust % 1000) for k, cust in ORDERS for c in CUSTOMERS if c % 5 and _name(c, 2) == f"block {k}" and c // 2 % 9 == k % 9]
    by_row, by_place = Counter(h[0] for h in hits), Counter(h[1] for h in hits)
    want = sorted((*h, by_row[h[0]] > 1 or by_place[h[1]] > 1) for h in hits)
    assert {h[0] % 4 for h in hits} == {0, 1, 2, 3}
    assert _rows(spark, "join8_table", tables, "row_index", "place_id", "value", "ambiguous") == want
