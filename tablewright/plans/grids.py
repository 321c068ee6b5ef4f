"""Report grids rendered from the cube, and what typing, headers and parsing make of them.

Table 1 is a composition table (markers, items, total), table 2 a margin table, table 3 head counts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import grid as G
from tablewright.plans.base import VIEWS, query

VIEWS["grid_rows"] = """
    SELECT code, year, k, table_id, CAST(row_number() OVER (PARTITION BY code, year, table_id ORDER BY part, kind, amount DESC, name) - 1 AS INT) AS r, c0, c1, c2, c3 FROM (
      SELECT code, year, k, 1 AS table_id, 0 AS part, 0 AS kind, CAST(0 AS DECIMAL(20,2)) AS amount, '' AS name, '项目' AS c0, '营业收入' AS c1, CASE WHEN k = 5 THEN '同比' ELSE '占营业收入比重' END AS c2, CAST(NULL AS STRING) AS c3 FROM reports
      UNION ALL SELECT code, year, k, 1, part, 0, CAST(0 AS DECIMAL(20,2)), '', CASE WHEN k = 3 THEN concat('（二）', marker) ELSE marker END, NULL, NULL, NULL FROM reports CROSS JOIN
        (SELECT 1 AS part, '分行业' AS marker UNION ALL SELECT 2, '分产品' UNION ALL SELECT 3, '分地区' UNION ALL SELECT 4, '销售模式') m
      UNION ALL SELECT code, year, k, 1, CASE dim WHEN 'industries' THEN 1 WHEN 'segments' THEN 2 WHEN 'regions' THEN 3 ELSE 4 END, 1, amount, name, concat('类', name), @money(amount),
        CASE WHEN k = 5 THEN '' ELSE concat(CAST(CAST(@places2(amount * 100 / t) AS DECIMAL(10,2)) AS STRING), '%') END, NULL FROM (SELECT *, sum(amount) OVER (PARTITION BY code, year, dim) AS t FROM golden) g
      UNION ALL SELECT code, year, k, 1, 9, 9, CAST(0 AS DECIMAL(20,2)), '', '合计', @money(revenue), '100.00%', NULL FROM anchor JOIN reports USING (code, year)
      UNION ALL SELECT code, year, k, 2, 0, 0, CAST(0 AS DECIMAL(20,2)), '', '分产品', '营业收入', '营业成本', '毛利率' FROM reports
      UNION ALL SELECT code, year, k, 2, 1, 1, amount, name, concat('类', name), @money(amount), @money(amount * 2), '50.00%' FROM golden WHERE dim = 'segments'
      UNION ALL SELECT code, year, k, 3, 0, 0, CAST(0 AS DECIMAL(20,2)), '', '专业构成', '人数', NULL, NULL FROM reports
      UNION ALL SELECT code, year, k, 3, 1, 1, CAST(n AS DECIMAL(20,2)), concat(dim, name), concat('员工', name), CAST(n AS STRING), '', NULL FROM emp) x"""
VIEWS["cells"] = """
    SELECT code, year, k, table_id, r, c, CASE c WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END AS v
    FROM grid_rows CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n WHERE c < 3 OR table_id = 2"""
#: Where each rendered table stands: its page, the section of the page, the lines above it.
VIEWS["table_meta"] = """
    SELECT code, year, table_id, CAST(10 * table_id + year % 5 AS INT) AS page, CASE WHEN (k + table_id) % 3 = 0 THEN 'other' WHEN table_id = 6 THEN 'gov' WHEN (k + year) % 2 = 0 THEN 'fuzhu' ELSE 'management' END AS section,
      CASE WHEN k = 6 THEN '' WHEN table_id = 1 AND k % 2 = 0 THEN '（1）营业收入构成' WHEN table_id = 1 THEN '单位：元' WHEN table_id = 2 AND k = 0 THEN '占公司营业收入10%以上的产品情况' WHEN table_id = 2 THEN '主营业务分产品情况 单位：元'
        WHEN table_id = 4 THEN '（5）营业成本构成' WHEN table_id = 5 THEN '研发投入' WHEN table_id IN (7, 8) THEN '主要客户' WHEN table_id IN (9, 10) THEN '主要供应商' ELSE '员工情况' END AS caption
    FROM reports CROSS JOIN (SELECT 1 AS table_id UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7 UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10) t"""
VIEWS["all_cells"] = "SELECT code, year, table_id, r, c, v FROM cells UNION ALL SELECT code, year, table_id, r, c, v FROM field_cells"
VIEWS["nested"] = """
    SELECT code, year, 1 AS table_id, CAST(row_number() OVER (PARTITION BY code, year ORDER BY o, name) - 1 AS INT) AS r, 'segments' AS dim, name, amount FROM (
      SELECT code, year, 0 AS o, '其中：首' AS name, CAST(1 AS DOUBLE) AS amount FROM reports WHERE k = 1 UNION ALL SELECT code, year, 100000, concat('P', name), CAST(5 AS DOUBLE) FROM golden WHERE dim = 'segments' AND k = 2
      UNION ALL SELECT code, year, 4, '其中：无', CAST(NULL AS DOUBLE) FROM reports WHERE k = 3 UNION ALL
      SELECT code, year, 3 * rn AS o, concat('P', name) AS name, CAST(amount AS DOUBLE) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY amount DESC, name) AS rn FROM golden WHERE dim = 'segments') a
      UNION ALL SELECT code, year, 3 * rn + 1, concat('其中：', name), CAST(amount AS DOUBLE) * 0.5 FROM (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY amount DESC, name) AS rn FROM golden WHERE dim = 'segments') b WHERE rn % 2 = 1
      UNION ALL SELECT code, year, 3 * rn + 2, concat('C', name), CAST(amount AS DOUBLE) * CASE WHEN rn % 3 = 0 THEN 0.75 ELSE 0.25 END FROM (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY amount DESC, name) AS rn FROM golden WHERE dim = 'segments') c WHERE rn % 2 = 1) n"""
VIEWS["placed"] = """
    SELECT lpad(CAST(l_suppkey AS STRING), 6, '0') AS code, CAST(year(l_shipdate) AS INT) AS year, l_orderkey * 10 + l_linenumber AS table_id, CAST(l_partkey % 4 + 10 AS INT) AS page,
           CAST(l_quantity * 14 AS DOUBLE) AS top, CAST(l_quantity * 14 + 60 AS DOUBLE) AS bottom, CAST(750 AS DOUBLE) AS page_h, CAST(l_linenumber % 2 + 2 AS INT) AS cols, l_partkey AS tie, l_extendedprice AS tie2 FROM lineitem"""

_MONEY = "regexp_full_match(trim(translate(v, ',，', ''), ' ' || chr(12288)), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')"
_SHARE = "contains(v, '%') AND TRY_CAST(translate(v, '%,', '') AS DOUBLE) BETWEEN 0 AND 100"
STATS = f"""st AS (SELECT code, year, table_id, c, count(*) FILTER (v <> '') AS n_cells, count(*) FILTER (regexp_matches(v, '[一-鿿]')) AS n_text, count(*) FILTER ({_MONEY}) AS n_money, count(*) FILTER ({_SHARE}) AS n_ratio FROM cells GROUP BY ALL)"""


ALL_STATS = STATS.replace("FROM cells", "FROM all_cells")


@query("q_col_stats", f"WITH {ALL_STATS} SELECT * FROM st")
def col_stats(load):
    return G.column_stats(load("all_cells"))


def _types(order: str) -> str:
    return f"""WITH {ALL_STATS}, a AS (SELECT code, year, table_id, min(c) FILTER (n_ratio >= 3) AS rc, arg_min(c, {order}) FILTER (n_money >= 3) AS best, count(*) AS n FROM st GROUP BY ALL),
    b AS (SELECT *, CASE WHEN best = rc THEN (SELECT min(c) FROM st WHERE st.code = a.code AND st.year = a.year AND st.table_id = a.table_id AND n_money >= 2 AND c <> rc) ELSE best END AS ac FROM a)
    SELECT b.code, b.year, b.table_id, coalesce(min(c) FILTER (n_text >= 3 AND c IS DISTINCT FROM rc AND c IS DISTINCT FROM ac), arg_min(c, (-n_text, c)) FILTER (n_text > 0 AND c IS DISTINCT FROM rc AND c IS DISTINCT FROM ac), 0) AS name_col,
      coalesce(any_value(ac), 0) AS amount_col, coalesce(any_value(rc), 0) AS ratio_col, any_value(n) AS col_count FROM b JOIN st USING (code, year, table_id) GROUP BY b.code, b.year, b.table_id"""


@query("q_col_types", _types("(-n_money, c)"))
def col_types(load):
    return G.column_types(load("all_cells"))


@query("q_col_types_first", _types("c"))
def col_types_first(load):
    return G.column_types(load("all_cells"), first_amount=True)


HEADERS = "hd AS (SELECT code, year, table_id, c, string_agg(v, ' ' ORDER BY r) AS header FROM cells WHERE r < 3 AND v <> '' GROUP BY ALL)"


@query("q_headers", f"WITH {HEADERS} SELECT * FROM hd")
def headers(load):
    return G.headers(load("cells"))


def _any(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


_KIND = {"name": "n_text", "revenue": "n_money", "ratio": "n_ratio", "cost": "n_money", "gross": "n_ratio"}
HEADCOLS = f"""WITH {STATS}, {HEADERS}, hc AS (SELECT code, year, table_id, {', '.join(f"min(c) FILTER ({_any('header', w)}) AS h_{r}" for r, w in G.ALIASES.items())} FROM hd GROUP BY ALL),
 s2 AS (SELECT *, max(n_cells) OVER (PARTITION BY code, year, table_id) AS n_rows FROM st),
 cols AS (SELECT code, year, table_id, {', '.join(f"arg_min(c, (abs(c - h_{r}), c)) FILTER ({k} >= least(2, greatest(1, n_rows - 1)) AND h_{r} IS NOT NULL) AS {'"' + r + '"'}" for r, k in _KIND.items())} FROM s2 LEFT JOIN hc USING (code, year, table_id) GROUP BY ALL)"""


@query("q_header_cols", HEADCOLS + " SELECT * FROM cols")
def header_cols(load):
    return G.header_columns(load("cells"))


FALLBACK = "fb AS (SELECT code, year, table_id, min(c) FILTER (n_text >= 2) AS t, list(c ORDER BY c) FILTER (n_money >= 2) AS m FROM st GROUP BY ALL)"


@query("q_resolve_cols", HEADCOLS + f""", {FALLBACK}, nq AS (SELECT code, year, table_id, coalesce(name, t, 0) AS name_col, revenue, m, CASE WHEN revenue IS DISTINCT FROM ratio THEN ratio END AS ratio_col FROM cols JOIN fb USING (code, year, table_id))
SELECT code, year, table_id, name_col, coalesce(revenue, list_filter(m, lambda x: x <> name_col AND x IS DISTINCT FROM ratio_col)[1]) AS amount_col, ratio_col FROM nq""")
def resolve_cols(load):
    return G.resolved_columns(load("cells"))


@query("q_ratio_sum_col", f"""WITH s AS (SELECT code, year, table_id, c, CASE WHEN {_SHARE} THEN TRY_CAST(translate(v, '%,', '') AS DOUBLE) END AS x FROM cells),
a AS (SELECT code, year, table_id, c, count(x) AS n, round(sum(x), 6) AS w, round(sum(x) FILTER (x < 99.5), 6) AS p FROM s GROUP BY ALL)
SELECT code, year, table_id, min(c) FILTER (n >= 2 AND (w BETWEEN 90 AND 110 OR p BETWEEN 90 AND 110)) AS c FROM a GROUP BY ALL""")
def ratio_sum_col(load):
    return G.ratio_sum_column(load("cells"))


@query("q_table_class", f"SELECT code, year, table_id, CASE WHEN coalesce(bool_or({_any('v', G.ALIASES['ratio'])}), false) THEN 'composition' WHEN coalesce(bool_or({_any('v', G.ALIASES['gross'])}), false) THEN 'margin' ELSE 'unknown' END AS table_class FROM cells WHERE r < 4 GROUP BY ALL")
def table_class(load):
    return G.table_class(load("cells"))


@query("q_argmax_cols", f"WITH {STATS} SELECT code, year, table_id, arg_max(c, (n_ratio, -c)) AS ratio_col, arg_max(c, (n_money, -c)) AS amount_col, arg_max(c, (n_text, -c)) AS name_col FROM st GROUP BY ALL")
def argmax_cols(load):
    best = lambda n: F.max_by("c", F.struct(n, -F.col("c")))
    return G.column_stats(load("cells")).groupBy(*G.TABLE).agg(best("n_ratio").alias("ratio_col"), best("n_money").alias("amount_col"), best("n_text").alias("name_col"))


@query("q_grid_width", "WITH rw AS (SELECT code, year, table_id, r, max(c) + 1 AS w FROM cells WHERE v IS NOT NULL GROUP BY ALL), n AS (SELECT code, year, table_id, w, count(*) AS n, min(r) AS f FROM rw GROUP BY ALL) SELECT code, year, table_id, arg_max(w, (n, -f)) AS modal, max(w) AS widest FROM n GROUP BY ALL")
def grid_width(load):
    return G.widths(load("cells").where("v is not null"))


@query("q_table_text", "SELECT code, year, table_id, string_agg(replace(v, chr(10), ' '), ' ' ORDER BY r, c) AS text FROM cells WHERE v <> '' GROUP BY ALL")
def table_text(load):
    return G.table_text(load("cells"))


@query("q_grid_text", """WITH u AS (SELECT *, max(coalesce(v <> '', false)) OVER (PARTITION BY code, year, table_id, c) AS used FROM cells)
SELECT code, year, table_id, r, string_agg(coalesce(v, ''), ' | ' ORDER BY c) AS line FROM u WHERE used GROUP BY ALL HAVING max(coalesce(v <> '', false))""")
def grid_text(load):
    return G.row_text(load("cells"))


@query("q_textdoc", r"""WITH l AS (SELECT *, regexp_replace(v, '[0-9.,%，。、()（）\-—:：\s年]', '', 'g') AS label FROM cells), f AS (SELECT code, year, table_id, label, min((r, c)) AS pos FROM l WHERE len(regexp_extract_all(label, '[一-鿿]')) >= 2 GROUP BY ALL)
SELECT code, year, table_id, substr(string_agg(label, ' ' ORDER BY pos), 1, 300) AS doc FROM f GROUP BY ALL""")
def textdoc(load):
    return G.text_doc(load("cells"))


@query("q_textdoc_caption", r"""WITH l AS (SELECT *, regexp_replace(v, '[0-9.,%，。、()（）\-—:：\s年]', '', 'g') AS label FROM cells), f AS (SELECT code, year, table_id, label, min((r, c)) AS pos FROM l WHERE len(regexp_extract_all(label, '[一-鿿]')) >= 2 GROUP BY ALL),
d AS (SELECT code, year, table_id, string_agg(label, ' ' ORDER BY pos) AS doc FROM f GROUP BY ALL) SELECT code, year, table_id, substr(concat_ws(' ', nullif(trim(caption), ''), doc), 1, 300) AS doc FROM d LEFT JOIN table_meta USING (code, year, table_id)""")
def textdoc_caption(load):
    return G.text_doc(load("cells"), load("table_meta"))


ROWS_SQL = "rw AS (SELECT code, year, k, table_id, r, c0, c1, c2, CASE WHEN ends_with(c0, '分行业') THEN 'industries' WHEN ends_with(c0, '分产品') THEN 'segments' WHEN ends_with(c0, '分地区') THEN 'regions' WHEN ends_with(c0, '销售模式') THEN 'by_channel' END AS marker FROM grid_rows WHERE table_id = 1)"


def _marked(load):
    return G.marked_rows(load("cells").where("table_id = 1"))


@query("q_row_sections", f"WITH {ROWS_SQL} SELECT code, year, table_id, r, marker FROM rw WHERE marker IS NOT NULL")
def row_sections(load):
    return _marked(load).where("marker is not null").select(*G.TABLE, "r", "marker")


@query("q_dim_fill", f"WITH {ROWS_SQL} SELECT code, year, table_id, r, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY code, year ORDER BY r), 'segments') AS dim FROM rw")
def dim_fill(load):
    return G.filled_dimension(_marked(load)).select(*G.TABLE, "r", "dim")


#: Rows of two filled cells (no shares, k = 5) are one text and give no amount.
ITEMS_SQL = "SELECT code, year, 1 AS table_id, dim, concat('类', name) AS name, CAST(amount AS DOUBLE) AS amount FROM golden WHERE k <> 5"


def _items(load):
    """Names and amounts of table 1, from the columns that typing finds."""
    cells = load("cells").where("table_id = 1")
    rows = G.filled_dimension(G.marked_rows(cells)).join(G.column_types(cells), list(G.TABLE))
    return G.row_items(rows).drop("seg")


@query("q_row_items", ITEMS_SQL)
def row_items(load):
    """Round trip: what is parsed from the rendered grids is what they were rendered from."""
    return _items(load).drop("r")


@query("q_dedup_first", ITEMS_SQL)
def dedup_first(load):
    items = _items(load)
    twice = items.unionByName(items.withColumn("r", F.col("r") + 1000).withColumn("amount", F.col("amount") * 2))
    return G.first_of_name(twice).drop("r")


#: The rule row by row: one step of the recursion takes the next row of every dimension.
CHILDREN_SQL = """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY code, year, table_id, dim ORDER BY r) AS i FROM nested),
f AS (SELECT code, year, table_id, dim, CAST(0 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS last, CAST(NULL AS DOUBLE) AS parent, CAST(0 AS DOUBLE) AS cum, CAST([] AS VARCHAR[]) AS names, false AS stays, CAST(NULL AS INT) AS r, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS DOUBLE) AS amount FROM n WHERE i = 1
 UNION ALL SELECT code, year, table_id, dim, i, CASE WHEN how = 'stay' THEN amount ELSE last END, CASE how WHEN 'open' THEN CASE WHEN last <> 0 AND amount IS NOT NULL THEN last END WHEN 'child' THEN parent WHEN 'none' THEN parent END,
  CASE how WHEN 'open' THEN coalesce(amount, 0) WHEN 'child' THEN cum + amount WHEN 'none' THEN cum ELSE 0 END, CASE WHEN how = 'stay' THEN list_append(names, name) ELSE names END, how = 'stay', r, name, amount
 FROM (SELECT f.code, f.year, f.table_id, f.dim, n.i, n.r, n.name, n.amount, f.last, f.parent, f.cum, f.names,
   CASE WHEN starts_with(n.name, '其中') THEN 'open' WHEN n.amount IS NULL THEN 'none' WHEN f.parent IS NOT NULL AND f.cum + n.amount <= f.parent * 1.02 THEN 'child' WHEN list_contains(f.names, n.name) THEN 'again' ELSE 'stay' END AS how
   FROM f JOIN n ON n.code = f.code AND n.year = f.year AND n.table_id = f.table_id AND n.dim = f.dim AND n.i = f.i + 1) s)
SELECT code, year, table_id, r, dim, name, amount FROM f WHERE stays"""
#: State: the row that may be a parent, how far its children reach and what they add up to; a row that folds goes.
PARENTS_SQL = """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY code, year, table_id, dim ORDER BY r) AS i FROM nested WHERE name NOT LIKE '其中%'),
l AS (SELECT code, year, table_id, dim, list(amount ORDER BY i) AS x, CAST(count(*) AS BIGINT) AS n FROM n GROUP BY ALL),
f AS (SELECT code, year, table_id, dim, x, n, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS j, CAST(0 AS DOUBLE) AS cum, CAST(0 AS BIGINT) AS gone FROM l
 UNION ALL SELECT code, year, table_id, dim, x, n, CASE WHEN hit THEN j + 2 WHEN ends THEN i + 1 ELSE i END, CASE WHEN hit THEN j + 2 WHEN ends THEN i + 1 ELSE j + 1 END, CASE WHEN hit OR ends THEN 0 ELSE cum + x[j + 1] END, CASE WHEN hit THEN i ELSE 0 END
 FROM (SELECT *, coalesce(x[i] = 0, true) OR j + 1 > n OR cum + x[j + 1] > x[i] * 1.01 AS ends, coalesce(x[i] <> 0 AND j + 1 <= n AND cum + x[j + 1] <= x[i] * 1.01 AND j + 1 - i >= 2 AND abs(cum + x[j + 1] - x[i]) <= x[i] * 0.01, false) AS hit FROM f WHERE i <= n) s)
SELECT n.code, n.year, n.table_id, n.r, n.dim, n.name, n.amount FROM n ANTI JOIN (SELECT DISTINCT code, year, table_id, dim, gone FROM f WHERE gone > 0) g ON g.code = n.code AND g.year = n.year AND g.table_id = n.table_id AND g.dim = n.dim AND g.gone = n.i"""


@query("q_child_runs", CHILDREN_SQL)
def child_runs(load):
    return G.without_children(load("nested"))


@query("q_fold_nested", PARENTS_SQL)
def fold_nested(load):
    return G.without_parents(load("nested").where("name not like '其中%'"))


@query("q_stitch_islands", """WITH l AS (SELECT *, lag(page) OVER w AS pp, lag(bottom) OVER w AS pb, lag(page_h) OVER w AS ph, lag(cols) OVER w AS pc FROM placed WINDOW w AS (PARTITION BY code, year ORDER BY page, top, table_id, tie, tie2)),
f AS (SELECT *, CASE WHEN coalesce(cols = pc AND cols <> 0 AND ((page = pp AND top - pb >= 0 AND top - pb < 35) OR (page = pp + 1 AND pb >= ph - 80 AND top <= 130)), false) THEN 0 ELSE 1 END AS starts FROM l)
SELECT code, year, count(*) AS n_tables, CAST(sum(starts) AS BIGINT) AS n_chains FROM f GROUP BY ALL""")
def stitch_islands(load):
    placed = load("placed").withColumn("table_id", F.struct("table_id", "tie", "tie2"))
    return G.stitched(placed).groupBy("code", "year").agg(F.count("*").alias("n_tables"), F.sum("starts").alias("n_chains"))


VIEWS["chained"] = """
    SELECT code, year, CAST(1 AS INT) AS chain, CAST(0 AS INT) AS ord, r, concat(c0, '|', coalesce(c1, '')) AS line FROM grid_rows WHERE table_id = 2
    UNION ALL SELECT code, year, 1, 1, r, concat(CASE WHEN k = 2 AND r = 0 THEN '续' ELSE '' END, c0, '|', coalesce(c1, '')) FROM grid_rows WHERE table_id = 2"""


@query("q_stitch_rows", """WITH h AS (SELECT *, first_value(line) OVER (PARTITION BY code, year, chain ORDER BY ord, r) AS head FROM chained)
SELECT code, year, chain, ord, r, line, CAST(row_number() OVER (PARTITION BY code, year, chain ORDER BY ord, r) - 1 AS INT) AS row FROM h WHERE NOT (ord > 0 AND r = 0 AND line = head)""")
def stitch_rows(load):
    return G.stitched_rows(load("chained"))


@query("q_patch_page", "SELECT code, year, page, count(*) AS n, CAST(sum(table_id) AS BIGINT) AS ids FROM (SELECT code, year, page, table_id FROM placed WHERE page <> 11 UNION ALL SELECT code, year, page, -table_id FROM placed WHERE page = 11 AND cols = 2) x GROUP BY ALL")
def patch_page(load):
    """All tables of one page replaced by others: old minus the page, and the new."""
    old = load("placed").select("code", "year", "page", "table_id")
    new = load("placed").where("page = 11 and cols = 2").select("code", "year", "page", (-F.col("table_id")).alias("table_id"))
    pages = old.where("page = 11").select("code", "year", "page").distinct()
    return old.join(pages, ["code", "year", "page"], "left_anti").unionByName(new).groupBy("code", "year", "page").agg(F.count("*").alias("n"), F.sum("table_id").alias("ids"))
