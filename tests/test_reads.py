"""How often the listings' queries read, shuffle and parse the table."""

import pytest
from pyspark.sql import functions as F

from brickledger.functions.text import pinned, pinned_number
from brickledger.operators import analysis
from verification import queries

SMALL = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_customers_meet_the_orders_before_the_line_items(spark):
    plan = optimized(queries.raw(spark, SMALL))
    assert 0 <= plan.index("Join Inner, (l_orderkey") < plan.index("Join Inner, (o_custkey")


def test_pinned_values_make_no_array_for_each_cell(spark):
    rows = spark.createDataFrame([("a", 1.5), (None, None), ("", -0.5)], "t string, x double")
    done = rows.select(pinned(F.col("t")).alias("t"), pinned_number(F.col("x")).alias("x"))
    assert [tuple(r) for r in done.collect()] == [("a", 1.5), (None, None), ("", -0.5)]
    plan = optimized(done.filter("t = 'a'"))
    assert "transform(" not in plan and plan.startswith("Filter")


def test_decades_read_the_table_once(spark):
    rows = spark.createDataFrame([(2011.0, 10.0)] * 3 + [(2022.0, 30.0), (2023.0, None), (None, 5.0)], "build_year double, unit_price double")
    assert "subquery" not in optimized(analysis.decade_avg(rows)).lower()
    assert analysis.decade_avg(rows).count() == 0
    assert {tuple(r) for r in analysis.decade_avg(rows, 4).collect()} == {(2010, 10.0), (2020, 30.0)}


def test_offered_tasks_of_parts_of_the_columns_are_one_read(spark):
    assert optimized(queries.QUERIES["applicable_tasks"](spark, SMALL)).count("l_orderkey#") == optimized(queries.QUERIES["task_status"](spark, SMALL)).count("l_orderkey#")
    rows = queries.parsed(spark, SMALL)
    some = rows.drop("area_m2", "floor_band")
    found = analysis.status_by_columns(rows, {"some": some.columns, "none": []}).drop("variant").collect()
    assert found == analysis.task_status(some).collect()


@pytest.mark.parametrize("key", ["iqr_filter", "quantiles_by_sketch"])
def test_prices_that_are_read_twice_are_parsed_once(spark, key):
    assert "l_orderkey" not in optimized(queries.QUERIES[key](spark, SMALL))
