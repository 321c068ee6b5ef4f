"""Cells as rectangles: three tables share a page and may run into each other; some rows lack the boxes of their last cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.operators import boxes as B
from tablewright.operators.grid import TABLE
from tablewright.plans.base import VIEWS, query
from tablewright.plans.fieldtables import _IS
from tablewright.session import kept

VIEWS["cell_rects"] = """
    SELECT code, year, table_id, CAST(10 + (table_id - table_id % 3) / 3 AS INT) AS page, r, c, CAST(40 + c * 110 + table_id AS DOUBLE) AS x0, CAST(60 + 200 * (table_id % 3) + 14 * r AS DOUBLE) AS y0,
           CAST(145 + c * 110 + table_id AS DOUBLE) AS x1, CAST(72 + 200 * (table_id % 3) + 14 * r AS DOUBLE) AS y1
    FROM all_cells WHERE NOT (r % 4 = 3 AND c >= 2) AND NOT (table_id = 3 AND r > 2)"""
VIEWS["sheets"] = "SELECT DISTINCT code, year, table_id, CAST(10 + (table_id - table_id % 3) / 3 AS INT) AS page FROM all_cells"
_BOXED = "bx AS (SELECT a.code, a.year, a.table_id, s.page, a.r, a.c, v, x0, y0, x1, y1 FROM all_cells a JOIN sheets s ON s.code = a.code AND s.year = a.year AND s.table_id = a.table_id LEFT JOIN cell_rects q ON q.code = a.code AND q.year = a.year AND q.table_id = a.table_id AND q.r = a.r AND q.c = a.c)"


def _tables(load):
    """Grids and, apart from them, rows of boxes as a reader finds them: some shorter than the grid's rows, some missing."""
    nested = lambda df, value: df.groupBy(*TABLE, "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", value.alias("v")))), lambda x: x["v"]).alias("row")).groupBy(*TABLE).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "row"))), lambda x: x["row"]).alias("rows"))
    grids = nested(load("all_cells").select(*TABLE, "r", "c", F.coalesce("v", F.lit("\0")).alias("v")), F.col("v")).withColumnRenamed("rows", "grid")
    grids = grids.withColumn("grid", F.transform("grid", lambda row: F.transform(row, lambda v: F.nullif(v, F.lit("\0")))))
    found = nested(load("cell_rects"), F.struct(*B.RECT)).withColumnRenamed("rows", "boxes")
    return grids.join(found, list(TABLE), "left").join(load("sheets"), list(TABLE))


@query("q_cell_boxes", f"WITH {_BOXED} SELECT * FROM bx")
def cell_boxes(load):
    """Boxes aligned to their grids, cell by cell."""
    return B.cell_boxes(_tables(load))


_NAME = "translate({0}, ' 　' || chr(9) || chr(10) || '、,，()（）', '')"
ATTACHED = f"""{_BOXED}, im AS (SELECT code, year, dim, CAST(row_number() OVER (PARTITION BY code, year, dim ORDER BY amount DESC, name) - 1 AS INT) AS idx, '类' || name AS name, CAST(amount AS DOUBLE) AS amount, ratio FROM shared),
 hd0 AS (SELECT b.code, b.year, b.table_id, r, c, k.key FROM bx b JOIN (SELECT DISTINCT code, year, {_NAME.format("name")} AS key FROM im) k ON k.code = b.code AND k.year = b.year AND k.key = {_NAME.format("v")}),
 bt AS (SELECT code, year, arg_max(table_id, (n, -table_id)) AS table_id FROM (SELECT code, year, table_id, count(DISTINCT r) AS n FROM hd0 GROUP BY ALL) q GROUP BY ALL),
 ft AS (SELECT hd0.code, hd0.year, hd0.table_id, key, min({{'r': r, 'c': c}}) AS pos FROM hd0 JOIN bt USING (code, year, table_id) GROUP BY ALL),
 pr AS (SELECT im.*, ft.table_id, pos.r AS r, pos.c AS name_c FROM im JOIN ft ON ft.code = im.code AND ft.year = im.year AND ft.key = {_NAME.format("im.name")}),
 pn AS (SELECT pr.*, b.c, page, x0, y0, x1, y1, CASE WHEN {_IS.format("replace(v, ',', '')")} THEN CAST(replace(v, ',', '') AS DOUBLE) END AS m, CASE WHEN contains(v, '%') THEN TRY_CAST(translate(v, '%,', '') AS DOUBLE) END AS q
   FROM pr JOIN bx b ON b.code = pr.code AND b.year = pr.year AND b.table_id = pr.table_id AND b.r = pr.r),
 pv AS (SELECT *, 'name' AS part FROM pn WHERE c = name_c
   UNION ALL SELECT *, 'amount' FROM pn WHERE abs(m - amount) <= greatest(1, abs(amount) * 1e-6) QUALIFY row_number() OVER (PARTITION BY code, year, dim, idx ORDER BY c) = 1
   UNION ALL SELECT *, 'ratio' FROM pn WHERE abs(q - ratio) <= 0.01 QUALIFY row_number() OVER (PARTITION BY code, year, dim, idx ORDER BY c) = 1),
 atd AS (SELECT code, year, dim, idx, part, table_id, page, r, c, x0, y0, x1, y1 FROM pv WHERE x0 IS NOT NULL)"""


def _attached(load):
    idx = F.row_number().over(Window.partitionBy("code", "year", "dim").orderBy(F.desc("amount"), "name")) - 1
    items = load("shared").select("code", "year", "dim", idx.alias("idx"), F.concat(F.lit("类"), "name").alias("name"), F.col("amount").cast("double").alias("amount"), "ratio")
    return B.attach(items, load("all_cells"), load("cell_rects"))


@query("q_provenance_boxes", f"WITH {ATTACHED} SELECT * FROM atd")
def provenance_boxes(load):
    """Page and rectangle of every name, amount and share that a parser gave."""
    return _attached(load)


_MEET = "NOT (a.x1 < b.x0 - 3 OR b.x1 < a.x0 - 3 OR a.y1 < b.y0 - 3 OR b.y1 < a.y0 - 3)"
_SHIFTED = "SELECT code, year, dim || '/' || idx || '/' || part AS value, page, x0 + 30 * (idx % 3) AS x0, y0 + 20 * (idx % 2) AS y0, x1 + 30 * (idx % 3) AS x1, y1 + 20 * (idx % 2) AS y1 FROM atd"


@query("q_prov_vote_boxes", f"""WITH {ATTACHED}, vs AS ({_SHIFTED}), ol AS (SELECT code, year, table_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM cell_rects GROUP BY ALL),
 pp AS (SELECT s.code, s.year, s.table_id, a.value, max(CASE WHEN EXISTS (SELECT 1 FROM cell_rects b WHERE b.code = a.code AND b.year = a.year AND b.page = a.page AND b.table_id = s.table_id AND {_MEET}) THEN 3 WHEN EXISTS (SELECT 1 FROM ol b WHERE b.code = a.code AND b.year = a.year AND b.table_id = s.table_id AND b.page = a.page AND {_MEET}) THEN 2 ELSE 1 END) AS v
   FROM sheets s JOIN vs a ON a.code = s.code AND a.year = s.year AND a.page = s.page GROUP BY ALL)
SELECT code, year, arg_max(table_id, (votes, -table_id)) AS table_id, CAST(max(votes) AS BIGINT) AS votes FROM (SELECT code, year, table_id, sum(v) AS votes FROM pp GROUP BY ALL) q GROUP BY ALL""")
def prov_vote_boxes(load):
    """The table that the values' rectangles point to; here values stand up to 60 points beside and 20 below their cells."""
    # read twice: by the count of a page's values and by the search; written once, else each would attach them anew
    at = kept(_attached(load), "attached")
    dx, dy = 30 * (F.col("idx") % 3), 20 * (F.col("idx") % 2)
    values = at.select("code", "year", F.concat_ws("/", "dim", "idx", "part").alias("value"), "page", *((F.col(k) + (dx if k[0] == "x" else dy)).alias(k) for k in B.RECT))
    rects = load("cell_rects")
    outlines = rects.groupBy(*TABLE, "page").agg(*((F.min if k[1] == "0" else F.max)(k).alias(k) for k in B.RECT))
    tables = load("sheets").join(outlines.drop("page"), list(TABLE), "left")
    return B.picked(B.votes(values, rects, tables))
