"""Parser plug-ins: a registered function from a report's tables to breakdown rows, run for each report in a Python worker.

Plug-ins are registered in code; nothing found on disk is executed. A plug-in that fails gives a row that says so,
which keeps one report's failure from ending a batch. The documented strategies are also here as SQL (``strategy``).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.operators import grid as G

OUT = "code string, year int, source string, dim string, idx int, name string, amount double, error string"
PLUGINS: dict[str, Callable[[list[dict]], list[tuple]]] = {}


def plugin(name: str):
    def put(f):
        PLUGINS[name] = f
        return f

    return put


@plugin("first_numbers")
def first_numbers(tables: list[dict]) -> list[tuple]:
    """(dim, name, amount) of rows whose second cell is a number, of the first table that has three."""
    for t in tables:
        rows = []
        for row in t["grid"]:
            try:
                rows.append(("_all", row[0] or "", float((row[1] or "").replace(",", ""))))
            except (ValueError, IndexError):
                continue
        if len(rows) >= 3:
            return rows
    return []


def run(cells: DataFrame, name: str) -> DataFrame:
    """A plug-in over all reports. A group is one report's cells, which a report's length bounds."""
    parse = PLUGINS[name]

    def one(df: pd.DataFrame) -> pd.DataFrame:
        code, year = df["code"].iloc[0], int(df["year"].iloc[0])
        try:
            tables = []
            for _, t in df.sort_values(["table_id", "r", "c"]).groupby("table_id", sort=True):
                tables.append({"grid": [list(v) for _, v in t.groupby("r", sort=True)["v"]]})
            rows = [(code, year, name, d, i, n, a, None) for i, (d, n, a) in enumerate(parse(tables))]
        except Exception as e:  # a plug-in's own fault becomes data
            rows = [(code, year, name, None, None, None, None, f"{type(e).__name__}: {e}"[:200])]
        return pd.DataFrame(rows, columns=["code", "year", "source", "dim", "idx", "name", "amount", "error"])

    return cells.select("code", "year", "table_id", "r", "c", "v").groupBy("code", "year").applyInPandas(one, OUT)


def bucket_columns(cells: DataFrame) -> DataFrame:
    """Without total rows, the share column is the leftmost whose sum over the largest dimension is 95..105; the amount column is the nearest on
    its left with two values over 1,000."""
    rows = G.filled_dimension(G.marked_rows(cells)).where(~T.is_total(F.get("row", F.lit(0)))).select(*G.TABLE, "r", "dim", "marker")
    j = cells.join(rows.where("marker is null"), [*G.TABLE, "r"])
    share = F.when(F.col("v").contains("%"), T.parse_ratio(F.col("v")))
    d = j.where(~F.col("dim").isNull()).groupBy(*G.TABLE, "dim", "c").agg(F.count(share).alias("n"), F.round(F.sum(share), 6).alias("s"), F.count_if(T.parse_money(F.col("v")) > 1000).alias("big"))
    # the dimension with most data rows, the first by name on ties
    size = d.groupBy(*G.TABLE, "dim").agg(F.max("n").alias("rows")).groupBy(*G.TABLE).agg(F.min_by("dim", F.struct(-F.col("rows"), "dim")).alias("top"))
    rc = d.join(size, list(G.TABLE)).where((F.col("dim") == F.col("top")) & (F.col("n") >= 2) & F.col("s").between(95, 105)).groupBy(*G.TABLE).agg(F.min("c").alias("ratio_col"))
    big = d.groupBy(*G.TABLE, "c").agg(F.sum("big").alias("big")).where("big >= 2")
    ac = big.join(rc, list(G.TABLE)).where("c < ratio_col").groupBy(*G.TABLE).agg(F.max("c").alias("amount_col"))
    return rc.join(ac, list(G.TABLE), "left")
