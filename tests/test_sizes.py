"""What only larger tables show: shares that a decimal quotient would round twice, broadcasts by the size of files, shuffles that stay."""

import os
import re

import duckdb
import pytest

from tablewright.operators import boxes as B
from tablewright.plans import base, boxing, grids, parsing  # noqa: F401  (define the views)
from tablewright.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")

#: Amount and whole whose share in percent lies less than 4e-8 below a half of its last place.
HALVES = [("81529199.16", "788865013.65", "10.33%"), ("121603519.05", "149804150.36", "81.17%"), ("498278371.71", "643978509.48", "77.37%"), ("190335663.48", "553381780.75", "34.39%"), ("-30576935.66", "658276332.92", "-4.64%")]


@pytest.mark.parametrize("amount,whole,want", HALVES)
def test_shares_are_rounded_once(spark, amount, whole, want):
    from tablewright.plans.fieldviews import _PCT

    sql = f"SELECT {_PCT.format('amount', 't')} AS v FROM (SELECT CAST('{amount}' AS DECIMAL(30,2)) AS amount, CAST('{whole}' AS DECIMAL(30,2)) AS t) x"
    assert spark.sql(base._expand(sql, True)).first().v == duckdb.sql(base._expand(sql, False)).fetchall()[0][0] == want


def test_shares_of_cells_at_a_half(spark):
    """1.005 % as a double lies below the half."""
    v = re.search(r"concat\(CAST\(CAST\(.*?'%'\)", base.VIEWS["grid_rows"])[0]
    sql = f"SELECT {v} AS v FROM (SELECT CAST('1005.00' AS DECIMAL(20,2)) AS amount, CAST('100000.00' AS DECIMAL(30,2)) AS t) x"
    assert spark.sql(base._expand(sql, True)).first().v == duckdb.sql(base._expand(sql, False)).fetchall()[0][0] == "1.00%"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


@needs_tables
def test_stored_views_are_not_broadcast_by_the_size_of_their_files(spark):
    """Ten rows of each report are a few kB of runs in a file; adaptive execution may still broadcast what it has seen."""
    j = base.view(spark, SF, "cells").join(base.view(spark, SF, "table_meta"), ["code", "year", "table_id"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        p = plan(j)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p


@needs_tables
def test_squares_and_empty_pages_do_not_travel(spark):
    """Rectangles are dealt by report; rows for each of their squares are made after that."""
    load = lambda n: base.view(spark, SF, n)
    values = load("cell_rects").where("table_id = 1 and r < 2").select("code", "year", "r", "page", *B.RECT).withColumnRenamed("r", "value")
    p = plan(B.votes(values, load("cell_rects"), load("sheets").selectExpr("*", "0D as x0", "0D as y0", "1D as x1", "1D as y1")))
    assert "bx" in p and not re.search(r"hashpartitioning\([^)]*\bb[xy]#", p)


@needs_tables
def test_attached_values_read_cells_in_one_shuffle(spark):
    p = plan(boxing._attached(lambda n: base.view(spark, SF, n)))
    assert not re.search(r"hashpartitioning\([^)]*\b(table_id|key|r)#", p)


@needs_tables
def test_shuffles_of_a_scan_go_with_its_write(spark):
    base.view(spark, SF, "field_cells"), base.view(spark, SF, "table_meta"), base.view(spark, SF, "cells")
    before = shuffles(spark)
    assert QUERIES["q_scan_tables"](spark, SF).count() > 0
    assert shuffles(spark) <= before + 1  # the count's own


@needs_tables
def test_parsers_of_all_fields_are_several_jobs(spark):
    """What is judged comes from files: the plans of seven parsers aren't one."""
    assert "Exchange" not in plan(parsing._candidates(lambda n: base.view(spark, SF, n)))
