"""Bank reports parsed whole, and tables chosen for each field; the SQL reads the text of the same grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import banks as B
from tablewright.plans import grids, paging  # noqa: F401  (define the views golden grids and report_page)
from tablewright.plans.base import VIEWS, query
from tablewright.plans.scalar import _BANK
from tablewright.plans.variants import _TOTAL, _money

#: Pages of bank reports, some with an announcement of a unit.
VIEWS["bank_page"] = """
    SELECT code, year, page, concat(text, CASE WHEN page = 3 THEN ' 单位：元' WHEN year % 3 = 0 THEN '' WHEN page % 29 = 17 THEN ' （货币单位：人民币百万元）' WHEN page % 13 = 12 THEN ' 单位：人民币千元' ELSE '' END) AS text FROM report_page WHERE k = 2"""
#: A table on every other page of a bank report, of four layouts: two are breakdowns, one counts staff, one names too little.
VIEWS["bank_meta"] = "SELECT code, year, page AS table_id, page, CASE page % 8 WHEN 0 THEN 'wide' WHEN 2 THEN 'swapped' WHEN 4 THEN 'staff' ELSE 'plain' END AS layout FROM report_page WHERE k = 2 AND page % 2 = 0"
VIEWS["bank_rows"] = """
    SELECT code, year, table_id, layout, CAST(row_number() OVER (PARTITION BY code, year, table_id ORDER BY part, amount DESC, name) - 1 AS INT) AS r, c0, c1, c2, c3 FROM (
      SELECT code, year, table_id, layout, 0 AS part, CAST(0 AS DECIMAL(20,2)) AS amount, '' AS name, '项 目' AS c0, CASE WHEN layout = 'staff' THEN '人数' ELSE '2024年 金额' END AS c1, '占比%' AS c2, CASE WHEN layout = 'staff' THEN '员工' ELSE '附注' END AS c3 FROM bank_meta
      UNION ALL SELECT code, year, table_id, layout, 1, CAST(0 AS DECIMAL(20,2)), '', '营业收入', @money(revenue), '100.00%', '' FROM bank_meta JOIN anchor USING (code, year)
      UNION ALL SELECT code, year, table_id, layout, 2, CAST(0 AS DECIMAL(20,2)), '', CASE WHEN layout = 'plain' THEN '收入' ELSE '利息净收入' END, @money(main_revenue), '61.50%', '' FROM bank_meta JOIN anchor USING (code, year)
      UNION ALL SELECT code, year, table_id, layout, 3, CAST(0 AS DECIMAL(20,2)), '', CASE WHEN layout = 'wide' THEN '非利息净收入' ELSE '其他业务收入' END, '38.5%', '', '' FROM bank_meta
      UNION ALL SELECT code, year, table_id, layout, 4, CAST(0 AS DECIMAL(20,2)), '', '2023年同比增减', '1.00', '2.00%', '' FROM bank_meta
      UNION ALL SELECT code, year, table_id, layout, 5, amount, name,
          CASE rn WHEN 1 THEN '' WHEN 2 THEN concat('类', name, '  注1') WHEN 3 THEN '甲' WHEN 5 THEN concat('类', name, '有一个很长很长的名称要在三十个字以后断开因为表格里写了太多的字') ELSE concat('类', name) END,
          CASE WHEN rn = 4 THEN '0.00' WHEN rn = 6 THEN '-' ELSE @money(amount) END, CASE WHEN rn = 4 THEN '120.00%' WHEN rn = 6 THEN '' ELSE '7.25%' END, CASE rn WHEN 1 THEN concat('补', name) WHEN 3 THEN '名称' ELSE '' END
        FROM bank_meta JOIN (SELECT code, year, name, amount, row_number() OVER (PARTITION BY code, year ORDER BY amount DESC, name) AS rn FROM golden WHERE dim = 'segments') g USING (code, year) WHERE rn <= 12
      UNION ALL SELECT code, year, table_id, layout, 6, CAST(0 AS DECIMAL(20,2)), '', '利息净收入', '5.00', '3.00%', '' FROM bank_meta) x"""
VIEWS["bank_cells"] = """
    SELECT code, year, table_id, r, c, CASE WHEN c = 0 THEN c0 WHEN c = 3 THEN c3 WHEN (c = 1) = (layout = 'swapped') THEN c2 ELSE c1 END AS v
    FROM bank_rows CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n"""

_HAS = lambda *ws: " OR ".join(f"contains(tx, '{w}')" for w in ws)
_SCORE = " + ".join([f"CASE WHEN {_HAS(*ws)} THEN {n} ELSE 0 END" for ws, n in B.ANY_WEIGHTS] + ["CASE WHEN " + " AND ".join(_HAS(w) for w in ws) + f" THEN {n} ELSE 0 END" for ws, n in B.ALL_WEIGHTS])
_PCT = "TRY_CAST(translate(translate(trim({0}), '(（', '--'), '%,)）', '') AS DOUBLE)"
PAGES_SQL = f"""hp AS (SELECT code, year, page, max(page) OVER (PARTITION BY code, year) AS m, {" OR ".join(f"contains(text, '{w}')" for w in B.PAGE_WORDS)} AS hit, contains(text, '营业收入') AND contains(text, '利息净收入') AS pair FROM bank_page),
 hq AS (SELECT *, bool_or(hit) OVER (PARTITION BY code, year) AS anyhit, min(page) FILTER (pair) OVER (PARTITION BY code, year) AS fp FROM hp),
 hn AS (SELECT DISTINCT code, year, page + d AS page FROM hq CROSS JOIN (SELECT unnest([-1, 0, 1]) AS d) d WHERE (hit OR (NOT anyhit AND page = fp)) AND page + d BETWEEN 16 AND m),
 bp AS (SELECT code, year, page FROM (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY page) AS rn FROM hn) x WHERE rn <= 15)"""
BANK_SQL = f"""{PAGES_SQL}, bh AS (SELECT b.code, b.year, b.table_id, b.page FROM bank_meta b JOIN bp ON b.code = bp.code AND b.year = bp.year AND b.page = bp.page),
 bc AS MATERIALIZED (SELECT code, year, table_id, page, r, c, coalesce(trim(v), '') AS v FROM bank_cells JOIN bh USING (code, year, table_id)),
 bt AS (SELECT code, year, table_id, page, string_agg(v, ' ' ORDER BY r, c) FILTER (v <> '') AS tx, count(DISTINCT r) AS nr FROM bc GROUP BY ALL),
 bs AS (SELECT code, year, table_id, page, {_SCORE} + CASE WHEN nr BETWEEN 5 AND 40 THEN 10 WHEN nr > 40 THEN -10 ELSE 0 END AS score FROM bt WHERE {_HAS(*B.NEEDED)}),
 bb AS (SELECT code, year, table_id FROM (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY score DESC, page, table_id) AS rn FROM bs WHERE score >= 40) x WHERE rn = 1),
 br AS MATERIALIZED (SELECT code, year, table_id, r, list(v ORDER BY c) AS x FROM bc SEMI JOIN bb USING (code, year, table_id) GROUP BY ALL),
 ct AS (SELECT code, year, table_id, c, count(*) FILTER (contains(v, '%') AND TRY_CAST(translate(v, '%,', '') AS DOUBLE) BETWEEN 0 AND 100) AS s, count(*) FILTER (({_money('v')}) IS NOT NULL) AS n, count(*) FILTER (regexp_matches(v, '[一-鿿]')) AS t FROM bc SEMI JOIN bb USING (code, year, table_id) GROUP BY ALL),
 cq AS (SELECT code, year, table_id, min(c) FILTER (s >= 3) AS qc, min(c) FILTER (n >= 3) AS fc FROM ct GROUP BY ALL),
 ca AS (SELECT *, CASE WHEN fc IS DISTINCT FROM qc THEN fc ELSE (SELECT min(c) FROM ct WHERE ct.code = cq.code AND ct.year = cq.year AND ct.table_id = cq.table_id AND n >= 2 AND c IS DISTINCT FROM qc) END AS ac FROM cq),
 cn AS (SELECT code, year, table_id, any_value(qc) AS qc, any_value(ac) AS ac, coalesce(min(c) FILTER (t >= 3 AND c IS DISTINCT FROM ac AND c IS DISTINCT FROM qc), arg_min(c, (-t, c)) FILTER (c IS DISTINCT FROM ac AND c IS DISTINCT FROM qc)) AS nc FROM ca JOIN ct USING (code, year, table_id) GROUP BY ALL),
 bn AS (SELECT code, year, table_id, r, CASE WHEN length(x[nc + 1]) >= 2 THEN x[nc + 1] ELSE list_filter(x, lambda y: regexp_matches(y, '[一-鿿]') AND length(y) >= 2)[1][:30] END AS name, coalesce(x[ac + 1], '') AS a, coalesce(x[qc + 1], '') AS q FROM br JOIN cn USING (code, year, table_id)),
 bv AS (SELECT code, year, table_id, r, name, {_money('a')} AS amount, coalesce({_PCT.format('q')}, CASE WHEN contains(a, '%') THEN {_PCT.format('a')} END) AS ratio FROM bn WHERE name NOT IN ('项 目', '项目') AND NOT {_TOTAL} AND NOT (regexp_matches(name, '年|金额|占比|增减') AND regexp_matches(name, '[0-9]'))),
 bw AS (SELECT *, row_number() OVER (PARTITION BY code, year, table_id, name ORDER BY r) AS nth FROM bv WHERE amount IS NOT NULL OR ratio IS NOT NULL),
 pu AS (SELECT code, year, page, coalesce({_BANK.replace("regexp_extract(u,", "regexp_extract(text,")}, 1) AS unit FROM bank_page),
 bu AS (SELECT code, year, CAST(arg_min(unit, page) AS INT) AS unit FROM pu WHERE unit <> 1 AND (page <= 10 OR EXISTS (SELECT 1 FROM bp WHERE bp.code = pu.code AND bp.year = pu.year AND abs(bp.page - pu.page) <= 1)) GROUP BY ALL),
 bi AS (SELECT code, year, coalesce(unit, 1) AS unit, CAST(row_number() OVER (PARTITION BY code, year ORDER BY r) - 1 AS INT) AS idx, trim(string_split(name, '  ')[1])[:30] AS name, round(nullif(amount, 0) * coalesce(unit, 1), 2) AS amount, CASE WHEN ratio BETWEEN 0 AND 100 THEN ratio END AS ratio FROM bw LEFT JOIN bu USING (code, year) WHERE nth = 1),
 bo AS (SELECT r.code, r.year, CASE WHEN bb.table_id IS NULL THEN 'no_table_found' ELSE 'ok' END AS status, bb.table_id, unit, idx, name, amount, ratio FROM (SELECT code, year FROM reports WHERE k = 2) r LEFT JOIN bb USING (code, year) LEFT JOIN bi USING (code, year))"""


def parsed(load):
    return B.parse(load("reports").where("k = 2"), load("bank_page"), load("bank_cells"), load("bank_meta"))


@query("q_bank_breakdown", f"WITH {BANK_SQL} SELECT * FROM bo")
def bank_breakdown(load):
    """Whole parses of all bank reports: pages, best table, columns, unit, unique names."""
    return parsed(load)


@query("q_bank_columns", f"WITH {BANK_SQL} SELECT code, year, table_id, nc AS name_col, ac AS amount_col, qc AS ratio_col FROM cn")
def bank_columns(load):
    """Columns of the tables that bank parses choose."""
    chosen = parsed(load).where("table_id is not null").select("code", "year", "table_id").distinct()
    return B.columns_of(load("bank_cells").join(chosen, ["code", "year", "table_id"], "left_semi"))


@query("q_bank_units", f"WITH {BANK_SQL} SELECT unit, count(*) AS n_reports FROM (SELECT code, year, coalesce(unit, 1) AS unit FROM reports LEFT JOIN bu USING (code, year) WHERE k = 2) x GROUP BY ALL")
def bank_units(load):
    """How many bank reports announce which unit near their breakdown or in front."""
    units = B.page_units(load("bank_page"), B.candidate_pages(load("bank_page")))
    every = load("reports").where("k = 2").select("code", "year").join(units, ["code", "year"], "left")
    return every.groupBy(F.coalesce("unit", F.lit(1)).alias("unit")).agg(F.count("*").alias("n_reports"))
