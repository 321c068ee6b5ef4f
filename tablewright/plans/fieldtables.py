"""Grids of costs, R&D, staff and the five largest clients and suppliers, and what the field parsers read from them.

Tables 4 costs, 5 R&D, 6 staff, 7 clients, 8 their summary, 9 suppliers, 10 their summary. The SQL of
each query parses the text of the grids, not the numbers that they were rendered from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.operators import fields as P
from tablewright.operators import grid as G
from tablewright.operators import reconcile as R
from tablewright.operators import selection as S
from tablewright.plans import fieldviews, grids  # noqa: F401  (define the views)
from tablewright.plans.base import VIEWS, query
from tablewright.plans.revenue import CONFIDENCE_SQL

_ROWS = "rw AS (SELECT code, year, table_id, r, list(coalesce(trim(v), '') ORDER BY c) AS x FROM field_cells GROUP BY ALL)"
_IS = "regexp_full_match({0}, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')"


def _nums(x: str, keep: str) -> str:
    """A list of the numbers among the texts of list x that pass a test on their text."""
    clean = "replace(replace(y, ',', ''), '%', '')"
    return f"list_transform(list_filter({x}, lambda y: {keep} AND {_IS.format(clean)}), lambda y: CAST({clean} AS DOUBLE))"


@query("q_cost_breakdown", f"""WITH {_ROWS}, n AS (SELECT code, year, table_id, r, x[1] AS industry, x[2] AS item, {_nums("x", "NOT contains(y, '%')")} AS n, {_nums("x", "contains(y, '%')")} AS p FROM rw WHERE table_id = 4 AND x[2] NOT IN ('', '项目', '金额', '同比增', '减') AND x[1] NOT IN ('', '行业分类'))
SELECT code, year, table_id, r, industry, item, round(nullif(n[1], 0), 2) AS amount_yuan, p[1] AS ratio_pct, round(nullif(n[2], 0), 2) AS amount_last_yuan, p[2] AS ratio_last_pct, CASE WHEN len(p) > 2 THEN p[-1] END AS yoy_change_pp FROM n""")
def cost_breakdown(load):
    return P.cost_items(load("field_cells").where("table_id = 4"))


@query("q_cost_table", """WITH t AS (SELECT code, year, table_id, string_agg(v, ' ' ORDER BY r, c) AS text FROM field_cells WHERE v <> '' AND table_id IN (4, 5, 7) GROUP BY ALL), m AS (SELECT *, contains(text, '占营业成本比重') OR contains(text, '营业成本构成') AS marked, 8 - table_id AS rank FROM t)
SELECT code, year, arg_min(table_id, (NOT marked, rank)) AS table_id, max(marked) AS marked FROM m GROUP BY ALL""")
def cost_table(load):
    """The table that a cold start takes from ranked candidates; ranks here run against the order of tables."""
    t = G.table_text(load("field_cells").where("table_id in (4, 5, 7)"))
    return P.cost_table(t.select(*G.TABLE, (8 - F.col("table_id")).alias("rank")), t)


_TYPES = f"""st AS (SELECT code, year, table_id, c, count(*) FILTER ({_IS.format("replace(v, ',', '')")}) AS n_money, count(*) FILTER (regexp_matches(v, '[一-鿿]')) AS n_text FROM field_cells WHERE table_id = 5 GROUP BY ALL),
 ac AS (SELECT code, year, table_id, coalesce(arg_min(c, (-n_money, c)) FILTER (n_money >= 3), 0) AS ac, arg_min(c, (-n_money, c)) FILTER (n_money >= 3) AS raw FROM st GROUP BY ALL),
 nc AS (SELECT st.code, st.year, st.table_id, any_value(ac) AS ac, coalesce(min(c) FILTER (n_text >= 3 AND c IS DISTINCT FROM raw), arg_min(c, (-n_text, c)) FILTER (n_text > 0 AND c IS DISTINCT FROM raw), 0) AS nc FROM st JOIN ac USING (code, year, table_id) GROUP BY ALL)"""
RND = f"""WITH {_ROWS}, {_TYPES}, n AS (SELECT rw.*, x[nc + 1] AS name, CASE WHEN {_IS.format("replace(x[ac + 1], ',', '')")} THEN CAST(replace(x[ac + 1], ',', '') AS DOUBLE) END AS a, {_nums("list_filter(x, lambda z, i: i <> ac + 1)", "NOT contains(y, '%')")} AS rest FROM rw JOIN nc USING (code, year, table_id)),
 ri AS (SELECT code, year, table_id, r, name, a AS amount_this, CASE WHEN a IS NOT NULL THEN coalesce(list_filter(rest[2:], lambda y: abs(y) < abs(a))[-1], rest[1]) END AS amount_last, name = '合计' AS is_total FROM n WHERE name NOT IN ('', '项目', '项 目'))"""


@query("q_rnd_items", RND + " SELECT * FROM ri")
def rnd_items(load):
    return P.rnd_items(load("field_cells").where("table_id = 5"))


@query("q_rnd_info", RND + " SELECT code, year, table_id, count(*) FILTER (NOT is_total) AS n_items, round(sum(amount_this) FILTER (NOT is_total), 2) AS items_this, arg_max(amount_this, r) FILTER (is_total) AS total_this, arg_max(amount_last, r) FILTER (is_total) AS total_last FROM ri GROUP BY ALL")
def rnd_info(load):
    return P.rnd_info(load("field_cells").where("table_id = 5")).withColumn("items_this", F.round("items_this", 2))


STAFF = f"""WITH {_ROWS}, s AS (SELECT code, year, table_id, r, trim(array_to_string(x, ' ')) AS label, CAST(replace(list_filter(x, lambda y: regexp_full_match(replace(y, ',', ''), '[+-]?[0-9]+'))[1], ',', '') AS BIGINT) AS n FROM rw WHERE table_id = 6),
 o AS (SELECT *, CASE label WHEN '专业构成' THEN 'composition' WHEN '教育程度' THEN 'education' END AS opens FROM s), m AS (SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY code, year, table_id ORDER BY r) AS mode FROM o),
 si AS (SELECT code, year, table_id, r, CASE WHEN contains(label, '在职员工的数量合计') THEN 'total' WHEN contains(label, '母公司在职员工') THEN 'parent' WHEN opens IS NULL AND n IS NOT NULL AND NOT contains(label, '类别') AND NOT contains(label, '合计') THEN mode END AS kind, string_split(label, ' ')[1] AS t, n FROM m)"""


@query("q_employees", STAFF + " SELECT code, year, table_id, r, kind, CASE WHEN kind IN ('composition', 'education') THEN t END AS type, n FROM si WHERE kind IS NOT NULL")
def employees(load):
    return P.staff_items(load("field_cells").where("table_id = 6"))


@query("q_staff", STAFF + """ SELECT code, year, max(n) FILTER (kind = 'total') AS total, max(n) FILTER (kind = 'parent' AND n <> 0) AS parent, count(*) FILTER (kind = 'composition') AS n_composition, CAST(sum(n) FILTER (kind = 'composition') AS BIGINT) AS sum_composition,
 count(*) FILTER (kind = 'education') AS n_education, CAST(sum(n) FILTER (kind = 'education') AS BIGINT) AS sum_education FROM si WHERE kind IS NOT NULL GROUP BY ALL""")
def staff(load):
    return P.staff(P.staff_items(load("field_cells").where("table_id = 6")))


def _top(side: int) -> str:
    return f"""WITH ln AS (SELECT code, year, table_id, r, string_agg(v, ' ' ORDER BY c) AS line FROM field_cells WHERE v <> '' AND table_id IN ({side}, {side + 1}) GROUP BY ALL), w AS (SELECT *, string_split(trim(line), ' ') AS w FROM ln),
 tr AS (SELECT code, year, table_id, r, CAST(list_filter(w, lambda y: regexp_full_match(y, '0*[1-5]'))[1] AS INT) AS rank, w FROM w WHERE table_id = {side}),
 it AS (SELECT code, year, table_id, r, rank, coalesce(list_filter(w, lambda y: NOT contains(y, '%') AND NOT {_IS.format("replace(y, ',', '')")} AND y NOT IN ('--', '-'))[1], '第' || rank || '名') AS name, list_filter({_nums("w", "NOT contains(y, '%')")}, lambda y: y > 100000)[1] AS amount,
   list_filter({_nums("w", "contains(y, '%')")}, lambda y: y BETWEEN 0 AND 100)[1] AS ratio_pct FROM tr WHERE rank IS NOT NULL),
 sm AS (SELECT code, year, max({_nums("w", "NOT contains(y, '%')")}[1]) FILTER (r = 0) AS total_amount, max({_nums("w", "contains(y, '%')")}[1]) FILTER (r = 1) AS total_ratio_pct, max({_nums("w", "contains(y, '%')")}[1]) FILTER (r = 2) AS related_party_ratio_pct FROM w WHERE table_id = {side + 1} GROUP BY ALL),
 dt AS (SELECT code, year, count(*) AS n, round(sum(amount), 2) AS items_amount, arg_min(name, (rank, r)) AS first_name FROM it GROUP BY ALL)"""


@query("q_top_rows", _top(7) + " SELECT * FROM it")
def top_rows(load):
    return P.top_rows(P.row_texts(load("field_cells").where("table_id = 7")))


for _name, _kind, _side in (("q_top_clients", "client", 7), ("q_top_suppliers", "supplier", 9)):

    @query(_name, _top(_side) + " SELECT code, year, n, items_amount, first_name, total_amount, total_ratio_pct, related_party_ratio_pct FROM dt FULL JOIN sm USING (code, year)")
    def top_five(load, kind=_kind, side=_side):
        """Detail rows and summary of a report's five largest partners, from its grids."""
        return P.top_five(load("field_cells").where(F.col("table_id").isin(side, side + 1)), kind).withColumn("items_amount", F.round("items_amount", 2))


@query("q_serialize", """WITH l AS (SELECT code, year, table_id, r, string_agg(trim(replace(v, chr(10), ' ')), ' | ' ORDER BY c) AS line FROM field_cells WHERE r < 40 AND trim(coalesce(v, '')) <> '' GROUP BY ALL) SELECT code, year, table_id, string_agg(line, chr(10) ORDER BY r) AS text FROM l GROUP BY ALL""")
def serialize(load):
    return P.serialized(load("field_cells"))


@query("q_provenance", """WITH i AS (SELECT code, year, dim, '类' || name AS name, CAST(amount AS DOUBLE) AS amount FROM pred), k AS (SELECT DISTINCT code, year, name FROM i), h AS (SELECT c.code, c.year, c.table_id, c.r, c.c, c.v FROM cells c JOIN k ON k.code = c.code AND k.year = c.year AND k.name = c.v),
 b AS (SELECT code, year, arg_max(table_id, (n, -table_id)) AS table_id FROM (SELECT code, year, table_id, count(DISTINCT r) AS n FROM h GROUP BY ALL) x GROUP BY ALL), f AS (SELECT h.code, h.year, h.table_id, v AS name, min((r, c)) AS pos FROM h JOIN b USING (code, year, table_id) GROUP BY ALL),
 p AS (SELECT i.*, f.table_id, pos[1] AS r, pos[2] AS name_c FROM i JOIN f USING (code, year, name)), x AS (SELECT code, year, table_id, r, c, TRY_CAST(replace(v, ',', '') AS DOUBLE) AS x FROM cells WHERE NOT contains(v, '%'))
SELECT p.code, p.year, p.dim, p.name, p.table_id, p.r, p.name_c, min(c) FILTER (abs(x - amount) <= greatest(1, abs(amount) * 1e-6)) AS amount_c FROM p LEFT JOIN x ON x.code = p.code AND x.year = p.year AND x.table_id = p.table_id AND x.r = p.r GROUP BY ALL""".replace("pos[1]", "pos.r").replace("pos[2]", "pos.c").replace("min((r, c)) AS pos", "min({'r': r, 'c': c}) AS pos"))
def provenance(load):
    items = load("pred").select("code", "year", "dim", F.concat(F.lit("类"), "name").alias("name"), F.col("amount").cast("double").alias("amount"))
    return P.provenance(items, load("cells"))


@query("q_reindex", "SELECT code, year, table_id, dim, r, name, CAST(row_number() OVER (PARTITION BY code, year, table_id, dim ORDER BY r) - 1 AS INT) AS idx FROM nested WHERE name NOT LIKE '其中%' AND r % 3 <> 1")
def reindex(load):
    """New indexes of the rows that are left; here every third row has gone."""
    return P.reindexed(load("nested").where("name not like '其中%' and r % 3 <> 1")).select(*G.TABLE, "dim", "r", "name", "idx")


@query("q_summaries", CONFIDENCE_SQL + """, d AS (SELECT code, year, string_agg(printf('%s=%.0f亿(%s)', dim, CAST(s AS DOUBLE) / 1e8, CASE WHEN abs(CAST(s AS DOUBLE) - revenue) <= 0.03 * revenue THEN '过锚' ELSE '✗' END), '  ' ORDER BY dim) AS dims, any_value(revenue) AS a FROM j GROUP BY ALL)
SELECT code, year, dims, CASE WHEN coalesce(a, 0) = 0 THEN '无锚' ELSE printf('%.2f亿', a / 1e8) END AS anchor FROM d""")
def summaries(load):
    """What prompts say of a report: sums of its dimensions and its anchor."""
    d = load("pred").groupBy("code", "year", "dim").agg(F.sum("amount").alias("s")).where("s <> 0").join(load("anchor").select("code", "year", F.col("revenue").cast("double").alias("a")), ["code", "year"], "left")
    d = d.withColumn("t", T.dim_summary(F.col("dim"), F.col("s").cast("double"), R.near(F.col("s"), F.col("a"), 0.03)))
    t = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dim", "t"))), lambda x: x["t"]), "  ")
    return d.groupBy("code", "year").agg(t.alias("dims"), F.first("a").alias("a")).select("code", "year", "dims", T.anchor_summary(F.col("a")).alias("anchor"))


@query("q_cross_page_suspect", "WITH n AS (SELECT *, lead(page) OVER (PARTITION BY code, year ORDER BY page, top, table_id, tie, tie2) AS np FROM placed) SELECT code, year, count(*) FILTER (coalesce(np IN (page, page + 1), false) AND bottom >= page_h - 90) AS n_suspect FROM n GROUP BY ALL")
def cross_page_suspect(load):
    """Tables that may go on overleaf: something follows, and they end within 90 points of the foot."""
    w = S.Window.partitionBy("code", "year").orderBy("page", "top", "table_id", "tie", "tie2")
    n = load("placed").withColumn("np", F.lead("page").over(w))
    follows = F.coalesce((F.col("np") == F.col("page")) | (F.col("np") == F.col("page") + 1), F.lit(False))
    return n.groupBy("code", "year").agg(F.count_if(follows & (F.col("bottom") >= F.col("page_h") - 90)).alias("n_suspect"))


VIEWS["boxes"] = "SELECT code, year, table_id, page, CAST(40 + table_id % 7 * 30 AS DOUBLE) AS x0, top AS y0, CAST(40 + table_id % 7 * 30 + 200 AS DOUBLE) AS x1, bottom AS y1 FROM placed"


@query("q_bbox_overlap", "SELECT a.code, a.year, a.page, count(*) AS n_pairs, count(*) FILTER (NOT (a.x1 < b.x0 - 3 OR b.x1 < a.x0 - 3 OR a.y1 < b.y0 - 3 OR b.y1 < a.y0 - 3)) AS n_overlap FROM boxes a JOIN boxes b ON a.code = b.code AND a.year = b.year AND a.page = b.page AND a.table_id < b.table_id GROUP BY ALL")
def bbox_overlap(load):
    """Tables that meet: rectangles with a tolerance of three points, within a page of a report."""
    a = load("boxes")
    b = a.select("code", "year", "page", *(F.col(c).alias(f"b_{c}") for c in ("table_id", "x0", "y0", "x1", "y1")))
    j = a.join(b, ["code", "year", "page"]).where("table_id < b_table_id")
    hit = T.overlap(*(F.col(c) for c in ("x0", "y0", "x1", "y1", "b_x0", "b_y0", "b_x1", "b_y1")))
    return j.groupBy("code", "year", "page").agg(F.count("*").alias("n_pairs"), F.count_if(hit).alias("n_overlap"))


@query("q_caption_above", r"SELECT doc_id, CASE WHEN doc_id % 7 > 1 THEN array_to_string((list_filter(list_transform(string_split(text, chr(10)), lambda y: trim(y, ' ' || chr(9) || chr(13))), lambda y: y <> ''))[-3:], ' ') ELSE '' END AS caption FROM documents")
def caption_above(load):
    """The last three filled lines above a table; its top stands in for the document's own."""
    return load("documents").select("doc_id", T.caption_above(F.split("text", "\n"), (F.col("doc_id") % 7).cast("double")).alias("caption"))
