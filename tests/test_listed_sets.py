"""Queries that list sets give all of them, also of a payment that more sets settle than a list holds by default."""

from __future__ import annotations

from datetime import datetime
from math import comb

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from __spark_entry__ import oracle_sql, queries

OPEN = 21


@pytest.fixture(scope="module")
def flood(tmp_path_factory):
    """A customer with 21 equal open invoices and a payment of three of them."""
    folder = tmp_path_factory.mktemp("flood")
    quiet = [k for k in range(5, 200) if k % 7 in (5, 6) and k % 10 != 9 and k % 37][: OPEN - 1]
    keys = sorted([*quiet, 10])
    pq.write_table(pa.table({"c_custkey": pa.array([1], pa.int64()), "c_nationkey": pa.array([3], pa.int32()), "c_mktsegment": ["BUILDING"]}), folder / "customer.parquet")
    pq.write_table(pa.table({
        "o_orderkey": pa.array(keys, pa.int64()), "o_custkey": pa.array([1] * OPEN, pa.int64()), "o_orderstatus": ["O"] * OPEN,
        "o_totalprice": pa.array([50000.0] * OPEN, pa.float64()), "o_orderdate": pa.array([datetime(1997, 1, 1 + k) for k in range(OPEN)], pa.timestamp("us"))}), folder / "orders.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["combination_facts", "combination_match_all", "multi_invoice_match_all", "combination_match", "multi_invoice_match"])
def test_all_sets_of_a_payment_are_listed(spark, flood, name):
    con = duckdb.connect()
    for table in ("customer", "orders"):
        con.execute(f"create view {table} as select * from '{flood}/{table}.parquet'")
    df = queries()[name](spark, flood)
    columns = sorted(df.columns)
    ours = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    sql = con.sql(oracle_sql()[name])
    theirs = sorted(tuple(str(r[sql.columns.index(c)]) for c in columns) for r in sql.fetchall())
    assert ours == theirs
    sets = len(ours) if name == "combination_facts" else len(ours[0][columns.index("competing")].split(","))
    assert sets == comb(OPEN - 1, 2) + comb(OPEN - 1, 3)
