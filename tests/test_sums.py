"""Sums of doubles that a query compares do not depend on the order of rows, so that groups of the same values tie."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import keyfold
from keyfold.functions import reducers
from keyfold.queries import QUERIES

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"


def test_q15_suppliers_that_tie(spark, tmp_path):
    """Suppliers 1 to 6 have the same prices in different orders, supplier 7 a cent less."""
    random.seed(3)
    prices = [round(random.uniform(900, 99999), 2) for _ in range(60)]
    rows = []
    for supplier in range(1, 8):
        for line, price in enumerate(random.sample(prices, len(prices))):
            rows.append((len(rows), 1, supplier, line, 1.0, price - 0.01 * (supplier == 7 and price == prices[0]), 0.07, 0.0, "N", "O"))
    lines = spark.createDataFrame(rows, LINE.rsplit(",", 1)[0]).selectExpr("*", "timestamp_ntz '1996-02-01 00:00:00' AS l_shipdate")
    lines.repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 9).selectExpr("id AS s_suppkey", "'S' || id AS s_name", "1 AS s_nationkey", "0D AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    got = QUERIES["q15"](spark, str(tmp_path)).collect()
    want = round(math.fsum(p * (1 - 0.07) for p in prices), 2)
    assert sorted((r.s_suppkey, r.s_name, r.total_revenue) for r in got) == [(k, f"S{k}", want) for k in range(1, 7)]


@pytest.mark.parametrize("low, high", [(1e-3, 1e-2), (-1, 1), (-1e5, 1e5), (1e12, 1e15)])
def test_sums_that_are_compared(spark, low, high):
    random.seed(5)
    values = [random.uniform(low, high) for _ in range(500)]
    rows = [(f"{g}", v) for g in range(8) for v in random.sample(values, len(values))]
    table = keyfold.Table(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, g string, v double").repartition(7), ["k"])
    got = keyfold.run(spark, keyfold.query("let s = {t.*.g: sum t.*.v}; let top = max s.*h; {s.*g == top & *g: s.*g}"), t=table).collect()
    assert len(got) == 8 and len(set(got.values())) == 1
    assert got["0"] == pytest.approx(math.fsum(values), rel=1e-15, abs=1e-15 * max(map(abs, values)))


@pytest.mark.parametrize("values, want", [([1e308, -1e308, 3.0], 3.0), ([float("inf"), 1.0], float("inf")), ([5e-324, 5e-324], 1e-323), ([-0.1], -0.1), ([1e300], 1e300), ([None, float("nan"), 2.5], 2.5), ([2.0**80, 0.25], 2.0**80), ([None], 0), ([], 0)])
def test_exact_sum_of_odd_values(spark, values, want):
    table = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    for exact in (True, False):
        assert table.agg(reducers.reduce("sum", F.col("v"), T.DoubleType(), [], False, exact)).collect()[0][0] == want
