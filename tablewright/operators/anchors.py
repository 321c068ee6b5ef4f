"""Anchors from a report's own tables: the first income statement, and what fills gaps of the database with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.operators.grid import TABLE, grid_rows

#: What an income statement holds, the lines that give anchors, and what a sum's name has.
STATEMENT, LINES, SUM = "营业总收入", {"revenue": "营业收入", "cost": "营业成本"}, "总"


def from_tables(cells: DataFrame) -> DataFrame:
    """code, year, revenue, cost from the first table of each report whose text has the statement's word: the first line for each
    whose first filled cell ends with its name, isn't a sum and holds a positive number; of these the first. Reports
    without such a table, or without any such line, have no row."""
    rows = grid_rows(cells)
    holds = rows.where(F.array_join("row", "").contains(STATEMENT)).groupBy("code", "year").agg(F.min("table_id").alias("_first"))
    lines = rows.join(holds, ["code", "year"]).where("table_id = _first")
    names = F.filter(F.transform("row", T.normal_label), lambda x: x != "")
    money = F.get(F.filter(F.transform("row", T.parse_money), lambda x: x > 0), F.lit(0))
    lines = lines.select("code", "year", "r", F.get(names, F.lit(0)).alias("name"), money.alias("x")).where(F.col("x").isNotNull() & ~F.col("name").contains(SUM))
    found = lines.groupBy("code", "year").agg(*(F.min_by("x", F.when(F.col("name").endswith(line), F.col("r"))).alias(key) for key, line in LINES.items()))
    return found.where(" or ".join(f"{key} is not null" for key in LINES))


def filled(database: DataFrame, derived: DataFrame) -> DataFrame:
    """code, year, the anchors, and from_tables, the names of those that the tables gave. The database's positive numbers hold; a gap,
    zero or less is filled from the tables. Reports that only one side has are kept."""
    d = derived.select("code", "year", *(F.col(k).alias(f"_{k}") for k in LINES))
    j = database.join(d, ["code", "year"], "full")
    own = {k: F.when(F.col(k) > 0, F.col(k).cast("double")) for k in LINES}
    given = F.array_join(F.array_compact(F.array(*(F.when(own[k].isNull() & F.col(f"_{k}").isNotNull(), k) for k in LINES))), ",")
    return j.select("code", "year", given.alias("from_tables"), *(F.coalesce(own[k], F.col(f"_{k}")).alias(k) for k in LINES))
