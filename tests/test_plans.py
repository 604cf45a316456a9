"""Parser, types, and the shape of physical plans."""

from pathlib import Path

import pytest
from pyspark.sql import types as T

import keyfold
from keyfold.queries import QUERIES
from keyfold.plans.syntax import parse
from keyfold.plans.types import parse_type, row_type


def test_arguments_reach_over_operators_but_not_pipes():
    assert parse("sum c & x") == ("call", ("name", "sum"), [("op", "&", ("name", "c"), ("name", "x"))])
    assert parse("sum x | f")[0] == "pipe"
    assert parse("1 + 2 * 3") == ("op", "+", ("num", 1), ("op", "*", ("num", 2), ("num", 3)))
    assert parse("data.*A?") == ("maybe", ("get", ("name", "data"), ("var", "*A")))
    assert parse("a.b # comment\n") == ("get", ("name", "a"), ("name", "b"))


def test_types():
    assert parse_type("{a: string, b: i32}") == T.StructType().add("a", T.StringType()).add("b", T.IntegerType())
    assert parse_type("{*u32: [f64]}") == T.MapType(T.LongType(), T.ArrayType(T.DoubleType()))
    assert row_type("{*u32: {d: date}}") == T.StructType().add("d", T.DateType())
    with pytest.raises(ValueError):
        parse_type("{a: nonsense}")


def plan(result) -> str:
    return result.df()._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS k", "id * 1.5D AS v", "'x' AS unused").write.parquet(str(tmp_path / "t"))
    table = keyfold.Table(spark.read.parquet(str(tmp_path / "t")), "id")
    text = plan(keyfold.run(spark, keyfold.query("{t.*.v > 100 & t.*.k: sum t.*.v}"), t=table))
    assert "GreaterThan(v,100.0)" in text and "unused" not in text
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1 and "Python" not in text


def test_reducers_over_one_domain_share_one_aggregation(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS k", "id * 1.5D AS v").write.parquet(str(tmp_path / "t"))
    table = keyfold.Table(spark.read.parquet(str(tmp_path / "t")), "id")
    text = plan(keyfold.run(spark, keyfold.query("{k: single t.*.k, s: sum t.*.v, n: count t.*.v, m: max t.*.v} | group t.*.k"), t=table))
    assert text.count("FileScan") == 1 and "Join" not in text and "SortAggregate" not in text


SF = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def query_plan(spark, name) -> str:
    return QUERIES[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()


@needs_tables
def test_groups_by_a_declared_key_need_no_aggregate(spark):
    text = query_plan(spark, "q5")
    assert text.count("Exchange hashpartitioning") <= 2 and text.count("FileScan") <= 8


@needs_tables
@pytest.mark.parametrize("name", ["join_anti", "set_except", "q22"])
def test_absent_lookups_are_anti_joins(spark, name):
    assert "LeftAnti" in query_plan(spark, name)


def test_group_by_key_keeps_conditions_and_empty_values(spark):
    table = keyfold.Table(spark.createDataFrame([(1, 5, None), (2, 7, 2.5), (3, None, 1.0)], "id int, v int, w double"), "id")
    got = keyfold.run(spark, keyfold.query("{t.*.id: {s: sum t.*.v, n: count t.*.w, a: array t.*.v, m: max t.*.w, big: sum (t.*.v > 6 & t.*.v)}}"), t=table).collect()
    assert got == {"1": {"s": 5, "n": 0, "a": [5], "m": float("-inf"), "big": 0}, "2": {"s": 7, "n": 1, "a": [7], "m": 2.5, "big": 7}, "3": {"s": 0, "n": 1, "a": [], "m": 1, "big": 0}}
