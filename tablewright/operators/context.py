"""What a reviewer sees of a chosen table's surroundings: the tables of its page and the pages beside it, and the one that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.operators import grid as G
from tablewright.operators.grid import TABLE

REPORT = ["code", "year"]


def described(cells: DataFrame, placed: DataFrame) -> DataFrame:
    """TABLE, page, top, bottom, page_h, caption, n_rows, n_cols (modal), row0 (cells of the first row, 24 characters each)
    of each table of ``placed`` (TABLE, page, top, bottom, page_h, caption)."""
    rows = G.grid_rows(cells)
    first = F.min_by(F.array_join(F.transform("row", lambda x: F.substring(x, 1, 24)), " | "), "r")
    shape = rows.groupBy(*TABLE).agg(F.count("*").alias("n_rows"), first.alias("row0"))
    return placed.join(shape, list(TABLE)).join(G.widths(cells).select(*TABLE, F.col("modal").alias("n_cols")), list(TABLE))


def neighbour_lines(picks: DataFrame, tables: DataFrame, most: int = 12) -> DataFrame:
    """code, year, picked, n, table_id, line: for each picked table (TABLE, page) the first ``most`` tables, in reading order, of its page
    and those before and after it. A pick takes a row for each of the three pages, which is an equal key; tables
    without a page are in none."""
    around = picks.select(*REPORT, F.col("table_id").alias("picked"), F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("page"))
    j = around.join(tables, [*REPORT, "page"])
    n = F.row_number().over(Window.partitionBy(*REPORT, "picked").orderBy("page", "top", "table_id"))
    foot = F.when(F.coalesce(F.col("bottom") >= F.col("page_h") - 90, F.lit(False)), " near_bottom=Y").otherwise("")
    caption = F.substring(T.strip(F.coalesce("caption", F.lit(""))), 1, 60)
    line = F.format_string("p%d rows=%d cols=%d%s cap=%s row0=[%s]", "page", "n_rows", "n_cols", foot, caption, "row0")
    return j.withColumn("n", n).where(F.col("n") <= most).select(*REPORT, "picked", "n", "table_id", line.alias("line"))


def following_content(picks: DataFrame, tables: DataFrame, cells: DataFrame, rows: int = 25) -> DataFrame:
    """TABLE, next_id, head and content of the table after each picked one in reading order, for tables that go on overleaf; no row for a
    report's last table. content has its first ``rows`` filled rows."""
    order = Window.partitionBy(*REPORT).orderBy("page", "top", "table_id")
    after = lambda c: F.lead(c).over(order)
    top = F.when(F.coalesce((F.col("page_h") > 0) & (F.col("top") <= 120), F.lit(False)), " top_of_page=Y").otherwise("")
    head = F.format_string("p%d rows=%d cols=%d%s cap=%s", "page", "n_rows", "n_cols", top, F.substring(T.strip(F.coalesce("caption", F.lit(""))), 1, 80))
    nexts = tables.withColumn("head", head).select(*TABLE, after("table_id").alias("next_id"), after("head").alias("head")).join(picks.select(*TABLE), list(TABLE), "left_semi").where("next_id is not null")
    lines = G.row_text(cells.where(F.col("r") < rows))
    text = lines.groupBy(*TABLE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias("content"))
    return nexts.join(text.select(*REPORT, F.col("table_id").alias("next_id"), "content"), [*REPORT, "next_id"], "left").select(*TABLE, "next_id", "head", F.coalesce("content", F.lit("")).alias("content"))
