"""Cells as rectangles on a page: aligned to ragged grids, attached to parsed values, and joined by where they lie.

Rectangles meet through a grid of squares: each takes a row for every square that it touches, squares are an equal key, and the
exact test follows. So a value meets the cells near it and not all cells of its page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.operators.grid import TABLE

RECT = ("x0", "y0", "x1", "y1")
PAGE = ["code", "year", "page"]
#: Points of a square's side; rectangles that come within TOLERANCE points meet.
SQUARE, TOLERANCE = 64, 3.0


def aligned(grid: Column, boxes: Column) -> Column:
    """The boxes in the grid's shape: null where a row of boxes is shorter, or absent; those beyond the grid go."""
    return F.transform(grid, lambda row, i: F.transform(row, lambda _, j: F.get(F.get(boxes, i), j)))


def cell_boxes(tables: DataFrame) -> DataFrame:
    """TABLE, page, r, c, v and the cell's rectangle (null without one) from (TABLE, page, grid, boxes)."""
    shaped = tables.select(*TABLE, "page", "grid", aligned(F.col("grid"), F.coalesce("boxes", F.expr("cast(array() as array<array<struct<x0:double,y0:double,x1:double,y1:double>>>)"))).alias("boxes"))
    rows = shaped.select(*TABLE, "page", F.posexplode(F.arrays_zip("grid", "boxes")).alias("r", "row"))
    cells = rows.select(*TABLE, "page", "r", F.posexplode(F.arrays_zip(F.col("row.grid").alias("v"), F.col("row.boxes").alias("box"))).alias("c", "x"))
    return cells.select(*TABLE, "page", "r", "c", F.col("x.v").alias("v"), *(F.col(f"x.box.{k}").alias(k) for k in RECT))


def attach(items: DataFrame, cells: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """code, year, dim, idx, part, table_id, page, r, c and rectangle of each value of (code, year, dim, idx, name, amount, ratio)
    that stands in a cell with one.

    Looked for in the table of the report in which most rows hold some item's name (equal without space and punctuation): the
    first row with the name, and in that row the first number within 1, or a millionth, of the amount, and the first percent figure within
    0.01 of the ratio. Where a name is missing, nothing of its item is attached; null values have no part.

    ``boxes`` (TABLE, page, r, c and rectangle) are the cells' rectangles where ``cells`` lacks them: values are looked for without
    them, and only what was found is joined to its rectangle. All is dealt by report once and joined without a further shuffle.
    """
    boxes = (cells if boxes is None else boxes).select(*TABLE, "page", "r", "c", *RECT).where("x0 is not null").repartition(*PAGE[:2])
    cells = cells.select(*TABLE, "r", "c", "v").repartition(*PAGE[:2])
    want = items.select("code", "year", "dim", "idx", "amount", "ratio", T.normal_name(F.col("name")).alias("key")).where("key <> ''").repartition(*PAGE[:2])
    named = cells.select(*TABLE, "r", "c", T.normal_name(F.col("v")).alias("key")).where("key <> ''")
    held = named.join(want.select("code", "year", "key").distinct(), ["code", "year", "key"])
    hits = held.groupBy(*TABLE).agg(F.count_distinct("r").alias("n"))
    best = hits.groupBy("code", "year").agg(F.max_by("table_id", F.struct("n", -F.col("table_id"))).alias("_best"))
    first = held.join(best, ["code", "year"]).where("table_id = _best").groupBy(*TABLE, "key").agg(F.min(F.struct("r", "c")).alias("at"))
    rows = want.join(first.select(*TABLE, "key", F.col("at.r").alias("r"), F.col("at.c").alias("name_c")), ["code", "year", "key"])
    v = F.col("v")
    near = rows.join(cells, [*TABLE, "r"]).withColumns({"_money": T.parse_money(v), "_share": F.when(v.contains("%"), T.parse_ratio(v))})
    money, share = F.col("_money"), F.col("_share")
    tests = {
        "name": F.col("c") == F.col("name_c"),
        "amount": F.abs(money - F.col("amount")) <= F.greatest(F.lit(1.0), F.abs("amount") * 1e-6),
        "ratio": F.abs(share - F.col("ratio")) <= 0.01,
    }
    found = near.groupBy("code", "year", "dim", "idx", "table_id", "r").agg(*(F.min(F.when(t, F.col("c"))).alias(part) for part, t in tests.items()))
    parts = F.inline(F.array(*(F.struct(F.lit(part).alias("part"), F.col(part).alias("c")) for part in tests)))
    at = found.select("code", "year", "dim", "idx", "table_id", "r", parts).where("c is not null")
    return at.join(boxes, [*TABLE, "r", "c"]).select("code", "year", "dim", "idx", "part", "table_id", "page", "r", "c", *RECT)


def _squares(a: str, b: str, wide: float) -> Column:
    return F.sequence(F.floor((F.col(a) - wide) / SQUARE), F.floor((F.col(b) + wide) / SQUARE))


def squared(rects: DataFrame, wide: float = 0.0) -> DataFrame:
    """A row for each square that a rectangle, made wider by ``wide`` on all sides, touches: bx and by."""
    return rects.withColumn("bx", F.explode(_squares("x0", "x1", wide))).withColumn("by", F.explode(_squares("y0", "y1", wide)))


def meeting(left: DataFrame, right: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Pairs of rectangles of a page that meet or come within the tolerance; the right one's columns, but PAGE's, have ``_`` before
    them. A pair may come several times, once for each square that both touch."""
    other = squared(right)
    other = other.select(*PAGE, "bx", "by", *(F.col(c).alias(f"_{c}") for c in right.columns if c not in PAGE))
    return squared(left, tolerance).join(other, [*PAGE, "bx", "by"]).where(T.overlap(*map(F.col, RECT), *(F.col(f"_{k}") for k in RECT), tolerance)).drop("bx", "by")


def votes(values: DataFrame, cells: DataFrame, tables: DataFrame) -> DataFrame:
    """TABLE and votes: of each value on the table's page 3 where a cell of it meets the value, 2 where only the table's outline does, else 1.

    ``values`` (code, year, value, page, RECT) may lack rectangles, and ``tables`` (TABLE, page, RECT) outlines; tables on
    pages without values have no row. As each value gives a table of its page 1 anyway, only what comes on top is
    searched for: no page's values are paired with all its tables. Everything is dealt by report first: a rectangle's rows, one for
    each square, are made after that and never travel, and those of pages without values aren't made.
    """
    values, cells, tables = (df.repartition(*PAGE[:2]) for df in (values, cells, tables))
    placed = values.where("x0 is not null").select(*PAGE, "value", *RECT)
    cells = cells.join(placed.select(*PAGE).distinct(), PAGE, "left_semi")
    cell = meeting(placed, cells.where("x0 is not null").select(*PAGE, "table_id", *RECT)).select(*PAGE, F.col("_table_id").alias("table_id"), "value", F.lit(2).alias("more"))
    outline = meeting(placed, tables.where("x0 is not null").select(*PAGE, "table_id", *RECT)).select(*PAGE, F.col("_table_id").alias("table_id"), "value", F.lit(1).alias("more"))
    more = cell.unionByName(outline).groupBy(*PAGE, "table_id", "value").agg(F.max("more").alias("more")).groupBy(*PAGE, "table_id").agg(F.sum("more").alias("more"))
    on_page = values.where("page is not null").groupBy(*PAGE).agg(F.count("*").alias("n"))
    return tables.select(*TABLE, "page").join(on_page, PAGE).join(more, [*PAGE, "table_id"], "left").select(*TABLE, "page", (F.col("n") + F.coalesce("more", F.lit(0))).alias("votes"))


def picked(voted: DataFrame) -> DataFrame:
    """code, year, table_id, votes: the table with most votes, the first of equals."""
    return voted.groupBy("code", "year").agg(F.max_by("table_id", F.struct("votes", -F.col("table_id"))).alias("table_id"), F.max("votes").alias("votes"))
