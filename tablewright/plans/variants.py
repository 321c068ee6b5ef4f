"""Parsers for single layouts, continued tables, re-extraction, certification and whole passes.

The SQL reads the text of the same grids: ``variant_cells`` are the field grids with the headings that those layouts have.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import scoring as S
from tablewright.operators import versions as V
from tablewright.operators.grid import TABLE
from tablewright.plans import ledgers
from tablewright.plans.base import ORACLES, VIEWS, query
from tablewright.plans.fieldtables import _IS
from tablewright.plans.scores import SCORES_SQL

VIEWS["variant_cells"] = """
    SELECT code, year, table_id, r, c, CASE WHEN table_id = 5 THEN replace(replace(v, '研发费用A', '新品开发费'), '研发费用N', '检测费') WHEN r = 0 AND c = 3 AND table_id = 7 THEN '占年度销售总额' WHEN r = 0 AND c = 3 AND table_id = 9 THEN '占年度采购' ELSE v END AS v FROM field_cells
    UNION ALL SELECT code, year, side, 6, c, CASE c WHEN 0 THEN '合计' WHEN 2 THEN '1,000,000.00' WHEN 3 THEN '90.00%' ELSE '' END FROM reports CROSS JOIN (SELECT 7 AS side UNION ALL SELECT 9) s CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n WHERE k <> 1"""
_BARE = "replace(coalesce(v, ''), ',', '')"
_TOTAL = "(regexp_matches(translate(name, ' 　', ''), '合计|总计|小计|总额|合計') OR translate(name, ' 　', '') IN ('营业收入', '主营业务收入', '营业总收入', '营业收入合计', '营业收入总额', '主营业务收入合计', '营业成本'))"


def _money(x: str) -> str:
    bare = f"replace({x}, ',', '')"
    return f"CASE WHEN {_IS.format(bare)} THEN CAST({bare} AS DOUBLE) END"


def _pct(x: str) -> str:
    return f"CASE WHEN contains({x}, '%') THEN TRY_CAST(translate({x}, '%,', '') AS DOUBLE) END"


def _base(table: str, big: int, where: str) -> str:
    """rw: rows as lists of the tables that qualify; cs: counts of their columns."""
    return f"""WITH tx AS (SELECT code, year, table_id FROM {table} GROUP BY ALL HAVING {where}), vc AS (SELECT t.code, t.year, t.table_id, r, c, trim(coalesce(v, '')) AS v FROM {table} t SEMI JOIN tx USING (code, year, table_id)),
 rw AS (SELECT code, year, table_id, r, list(v ORDER BY c) AS x FROM vc GROUP BY ALL),
 cs AS (SELECT code, year, table_id, c, count(*) FILTER ({_pct('v')} BETWEEN 0 AND 100) AS n_share, round(sum({_pct('v')}) FILTER ({_pct('v')} BETWEEN 0 AND 100), 6) AS shares, count(*) FILTER (contains(v, '%')) AS n_percent, count(*) FILTER ({_money('v')} > {big}) AS n_big, count(*) FILTER (regexp_matches(v, '[一-鿿]')) AS n_text, count(*) FILTER (regexp_matches(v, '[一-鿿]') AND NOT contains(v, '名称')) AS n_name FROM vc GROUP BY ALL)"""


_TEXT = "string_agg(v, '' ORDER BY r, c)"
_FIRST = "SELECT code, year, table_id, r, dim, name, amount, ratio FROM (SELECT *, min(CASE WHEN {0} THEN table_id END) OVER (PARTITION BY code, year) AS ft FROM it) z WHERE table_id = ft"
_LEFT = """, rc AS (SELECT code, year, table_id, min(c) AS rc FROM cs WHERE {0} GROUP BY ALL), mc AS (SELECT code, year, table_id, rc, max(c) AS mc FROM cs JOIN rc USING (code, year, table_id) WHERE c < rc AND n_big >= 2 GROUP BY ALL)"""


@query("q_v_costs", _base("variant_cells", 1000, f"contains({_TEXT}, '占营业成本比重') OR contains({_TEXT}, '占成本比重')") + _LEFT.format("n_share >= 2 AND shares BETWEEN 95 AND 105") + f""",
 nc AS (SELECT mc.*, coalesce((SELECT max(c) FROM cs WHERE cs.code = mc.code AND cs.year = mc.year AND cs.table_id = mc.table_id AND c < mc AND n_text >= 2), 0) AS nc FROM mc),
 it AS (SELECT code, year, table_id, r, 'costs' AS dim, x[nc + 1] AS name, {_money('x[mc + 1]')} AS amount, TRY_CAST(translate(x[rc + 1], '%,', '') AS DOUBLE) AS ratio FROM rw JOIN nc USING (code, year, table_id) WHERE x[nc + 1] <> '' AND TRY_CAST(translate(x[rc + 1], '%,', '') AS DOUBLE) IS NOT NULL)
""" + _FIRST.format("true") + f" AND NOT {_TOTAL}")
def flat_costs(load):
    return V.flat_costs(load("variant_cells"))


@query("q_v_staff", _base("variant_cells", 0, f"contains({_TEXT}, '专业构成') AND contains({_TEXT}, '教育程度')") + f""",
 s AS (SELECT code, year, table_id, r, coalesce(list_filter(x, lambda y: y <> '')[1], '') AS name, list_filter(list_transform(x, lambda y: {_money('y')}), lambda y: y IS NOT NULL)[1] AS n FROM rw),
 o AS (SELECT *, CASE WHEN contains(name, '在职员工的数量合计') THEN NULL WHEN contains(name, '专业构成') THEN 'composition' WHEN contains(name, '教育程度') THEN 'education' END AS opens FROM s), m AS (SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY code, year, table_id ORDER BY r) AS mode FROM o),
 it AS (SELECT code, year, table_id, r, CASE WHEN contains(name, '在职员工的数量合计') THEN 'total' ELSE mode END AS dim, name, round(n) AS amount, CAST(NULL AS DOUBLE) AS ratio FROM m WHERE n IS NOT NULL AND (contains(name, '在职员工的数量合计') OR (opens IS NULL AND mode IS NOT NULL AND name <> '' AND NOT {_TOTAL})))
""" + _FIRST.format("dim <> 'total'"))
def staff_lists(load):
    return V.staff_lists(load("variant_cells"))


@query("q_v_rnd", _base("(SELECT * FROM variant_cells SEMI JOIN (SELECT * FROM table_meta WHERE section = 'fuzhu') q USING (code, year, table_id))", 1000, " AND ".join(f"contains({_TEXT}, '{w}')" for w in V.RND_WORDS)) + f""",
 w AS (SELECT code, year, table_id, (list(c ORDER BY c))[1] AS ac, (list(c ORDER BY c))[2] AS lc FROM cs WHERE n_big >= 3 GROUP BY ALL),
 a AS (SELECT code, year, table_id, r, coalesce(list_filter(x, lambda y: regexp_matches(y, '[一-鿿]'))[1], '') AS name, {_money('x[ac + 1]')} AS amount, {_money('x[lc + 1]')} AS ratio FROM rw JOIN w USING (code, year, table_id)),
 it AS (SELECT *, CASE WHEN {_TOTAL} THEN 'total' ELSE 'detail' END AS dim FROM a WHERE name NOT IN ('', '项目') AND amount IS NOT NULL),
 sm AS (SELECT code, year, table_id, sum(amount) FILTER (dim = 'detail') AS s, arg_max(amount, r) FILTER (dim = 'total') AS t, max(r) FILTER (dim = 'total') AS tr FROM it GROUP BY ALL HAVING count(*) FILTER (dim = 'detail') > 0),
 b AS (SELECT code, year, arg_min(table_id, (NOT coalesce(t <> 0 AND abs(s - t) <= greatest(1, t * 1e-4), false), table_id)) AS table_id FROM sm GROUP BY ALL)
SELECT it.code, it.year, it.table_id, r, dim, name, amount, ratio FROM it JOIN b USING (code, year, table_id) JOIN sm USING (code, year, table_id) WHERE dim = 'detail' OR r = tr""")
def rnd_details(load):
    """Here ``ratio`` is the amount of the period before."""
    return V.rnd_details(load("variant_cells"), load("table_meta"))


for _name, _kind in (("q_v_clients", "client"), ("q_v_suppliers", "supplier")):

    @query(_name, _base("variant_cells", 10000, " AND ".join(f"contains({_TEXT}, '{w}')" for w in V.PARTNER_WORDS[_kind])) + f""",
 w AS (SELECT code, year, table_id, arg_min(c, (-n_percent, c)) AS rc, arg_min(c, (-n_big, c)) AS mc, arg_min(c, (-n_name, c)) AS nc FROM cs GROUP BY ALL),
 a AS (SELECT code, year, table_id, r, regexp_matches(array_to_string(x, ''), '合计|小计') AS tot, x[nc + 1] AS name, {_money('x[mc + 1]')} AS amount, {_pct('x[rc + 1]')} AS ratio FROM rw JOIN w USING (code, year, table_id)),
 it AS (SELECT code, year, table_id, r, CASE WHEN tot THEN 'total' ELSE '{_kind}' END AS dim, CASE WHEN tot THEN '' ELSE name END AS name, amount, ratio FROM a WHERE ratio IS NOT NULL AND (tot OR (name <> '' AND NOT contains(name, '{V.PARTNER_WORDS[_kind][0]}'))))
""" + _FIRST.format("dim <> 'total'"))
    def partners(load, kind=_kind):
        return V.partners(load("variant_cells"), kind)


#: Revenue grids in which every marker is one of those layouts', margin tables before composition tables.
VIEWS["bucket_cells"] = "SELECT code, year, 4 - table_id AS table_id, r, c, CASE WHEN v = '销售模式' THEN '分销售模式' ELSE v END AS v FROM cells"
_DIM = "CASE {0} WHEN '分行业' THEN 'industries' WHEN '分产品' THEN 'segments' WHEN '分地区' THEN 'regions' WHEN '分销售模式' THEN 'by_channel' END"


@query("q_v_buckets", _base("bucket_cells", 1000, f"contains({_TEXT}, '分产品') OR contains({_TEXT}, '分地区')") + f""",
 m AS (SELECT *, {_DIM.format("x[1]")} AS marker, replace(x[1], ' ', '') AS name FROM rw), d AS (SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY code, year, table_id ORDER BY r), 'industries') AS dim FROM m),
 g AS (SELECT * FROM d WHERE marker IS NULL AND name <> '' AND NOT {_TOTAL} AND len(list_filter(x[2:], lambda y: coalesce({_pct('y')} BETWEEN 0 AND 100, false))) > 0),
 tp AS (SELECT code, year, table_id, arg_min(dim, (-n, f)) AS dim FROM (SELECT code, year, table_id, dim, count(*) AS n, min(r) AS f FROM g GROUP BY ALL) q GROUP BY ALL),
 e AS (SELECT code, year, table_id, dim, c - 1 AS c, x[c] AS v FROM (SELECT g.*, unnest(range(1, len(x) + 1)) AS c FROM g) q),
 rc AS (SELECT code, year, table_id, min(c) AS rc FROM (SELECT code, year, table_id, c FROM e SEMI JOIN tp USING (code, year, table_id, dim) WHERE c >= 1 AND {_pct('v')} BETWEEN 0 AND 100 GROUP BY ALL HAVING count(*) >= 2 AND round(sum({_pct('v')}), 6) BETWEEN 95 AND 105) q GROUP BY ALL),
 mc AS (SELECT code, year, table_id, max(c) AS mc FROM (SELECT e.code, e.year, e.table_id, c FROM e JOIN rc USING (code, year, table_id) WHERE c < rc AND {_money('v')} > 1000 GROUP BY ALL HAVING count(*) >= 2) q GROUP BY ALL),
 it AS (SELECT code, year, table_id, r, dim, x[1] AS name, {_money('x[mc + 1]')} AS amount, TRY_CAST(translate(x[rc + 1], '%,', '') AS DOUBLE) AS ratio FROM g JOIN rc USING (code, year, table_id) LEFT JOIN mc USING (code, year, table_id) WHERE TRY_CAST(translate(x[rc + 1], '%,', '') AS DOUBLE) IS NOT NULL)
""" + _FIRST.format("dim IN ('segments', 'industries')"))
def buckets(load):
    return V.buckets(load("bucket_cells"))


@query("q_v_two_years", _base("bucket_cells", 10000, f"contains({_TEXT}, '%') AND (contains({_TEXT}, '分产品') OR contains({_TEXT}, '分行业') OR contains({_TEXT}, '分地区'))") + _LEFT.format("n_share >= 2") + f""",
 m AS (SELECT *, {_DIM.format("x[1]")} AS marker, coalesce(list_filter(x, lambda y: regexp_matches(y, '[一-鿿]'))[1], '') AS name FROM rw), d AS (SELECT *, coalesce(last_value(marker IGNORE NULLS) OVER (PARTITION BY code, year, table_id ORDER BY r), 'segments') AS dim FROM m),
 a AS (SELECT code, year, table_id, r, dim, name, {_money('x[mc + 1]')} AS amount, {_pct('x[rc + 1]')} AS p FROM d JOIN mc USING (code, year, table_id) WHERE marker IS NULL AND name <> '' AND NOT {_TOTAL}),
 it AS (SELECT code, year, table_id, r, dim, name[:30] AS name, amount, CASE WHEN p BETWEEN 0 AND 100 THEN p END AS ratio FROM a WHERE amount IS NOT NULL OR p IS NOT NULL)
""" + _FIRST.format("true"))
def two_years(load):
    return V.two_years(load("bucket_cells"))


VIEWS["spread"] = "SELECT lpad(CAST(l_suppkey AS STRING), 6, '0') AS code, CAST(year(l_shipdate) AS INT) AS year, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS table_id, CAST(l_partkey % 40 + 10 AS INT) AS page, CAST(l_partkey % 9 + 1 AS INT) AS width, l_linenumber % 3 = 0 AS repeats FROM lineitem"


@query("q_continued", """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY page, table_id, width, repeats) AS i FROM spread),
f AS (SELECT code, year, i, table_id, page, width, 1 AS chain, false AS cut FROM n WHERE i = 1
 UNION ALL SELECT code, year, i, table_id, CASE WHEN goes THEN hp ELSE page END, CASE WHEN goes THEN greatest(hw, width) ELSE width END, chain + CASE WHEN goes THEN 0 ELSE 1 END, goes AND repeats
 FROM (SELECT n.*, f.page AS hp, f.width AS hw, f.chain, n.page IN (f.page, f.page + 1) AND abs(f.width - n.width) <= 2 AS goes FROM f JOIN n ON n.code = f.code AND n.year = f.year AND n.i = f.i + 1) s)
SELECT code, year, table_id, chain, cut FROM f""")
def continued(load):
    """Chains of continued tables as generated parsers merge them."""
    return V.continued(load("spread"))


VIEWS["page_of"] = "SELECT code, year, table_id, CAST(table_id - table_id % 2 AS INT) AS page FROM table_meta WHERE table_id <= 3"


@query("q_page_merged", """WITH p AS (SELECT code, year, table_id, page, r, c, trim(coalesce(v, '')) AS v FROM cells JOIN page_of USING (code, year, table_id)), w AS (SELECT code, year, page, max(c) + 1 AS w FROM p GROUP BY ALL HAVING count(DISTINCT table_id) > 1),
 l AS (SELECT code, year, page, table_id, r, list(v ORDER BY c) AS x FROM p GROUP BY ALL)
SELECT code, year, page, CAST(row_number() OVER (PARTITION BY code, year, page ORDER BY table_id, r) - 1 AS INT) AS r, array_to_string(list_transform(list_resize(x, w, ''), lambda y: y), '|') AS line FROM l JOIN w USING (code, year, page)""")
def page_merged(load):
    """All tables of a page as one more candidate."""
    return V.page_merged(load("cells"), load("page_of")).select("code", "year", "page", "r", F.array_join("row", "|").alias("line"))


VIEWS["trials"] = """
    SELECT code, year, 'lines_lines' AS profile, 0 AS ord, dim, name, amount FROM pred UNION ALL SELECT code, year, 'text_text', 1, dim, name, amount FROM golden WHERE k <> 4
    UNION ALL SELECT code, year, 'snap_loose', 2, dim, name, amount FROM golden WHERE k <> 2"""
VIEWS["kept_profiles"] = "SELECT code, year, CASE WHEN year % 2 = 0 THEN 'snap_loose' ELSE 'text_text' END AS profile FROM reports WHERE k IN (2, 3, 4)"


@query("q_extract_heal", """WITH s AS (SELECT code, year, profile, ord, dim, CAST(sum(amount) AS DOUBLE) AS s FROM trials GROUP BY ALL HAVING sum(amount) <> 0),
 t AS (SELECT code, year, s.profile, ord, bool_and(coalesce(abs(s - CAST(revenue AS DOUBLE)) <= 0.03 * CAST(revenue AS DOUBLE), false)) AS ok FROM s LEFT JOIN anchor USING (code, year) GROUP BY ALL),
 n AS (SELECT t.*, row_number() OVER (PARTITION BY t.code, t.year ORDER BY k.profile IS DISTINCT FROM t.profile, ord) AS n FROM t LEFT JOIN kept_profiles k USING (code, year))
SELECT code, year, CASE WHEN bool_or(ok) THEN 'fixed' ELSE 'still_bad' END AS outcome, arg_min(profile, n) FILTER (ok) AS profile, CAST(coalesce(min(n) FILTER (ok), max(n)) AS INT) AS n_tries FROM n GROUP BY ALL""")
def extract_heal(load):
    """All extraction profiles of a report at once; the first that the anchor confirms wins, a kept one before the others."""
    return V.extraction_heal(load("trials"), load("anchor"), load("kept_profiles"))


@query("q_recode", SCORES_SQL + " SELECT code, year, score, CASE WHEN score IS NULL THEN 'no_golden' WHEN exact THEN 'certified' ELSE 'not_exact' END AS status FROM reports LEFT JOIN (SELECT * FROM sc WHERE version = 'fixed') s USING (code, year)")
def recode(load):
    """A rewritten parser on every report: its score against golden data, and whether it may be certified."""
    mine = F.col("version") == "fixed"
    return V.certifiable(load("reports"), S.score_fields(load("truths").where(mine), load("versions").where(mine)))


_CASCADE = ORACLES["q_heal_cascade"]


@query("q_full_pass")
def full_pass(load):
    """One job over all reports that no earlier pass has finished: parse, judge and mend; how many end in which outcome."""
    left = ledgers.resume(load)
    return ledgers.heal_cascade(load).join(left, ["code", "year"], "left_semi").groupBy("outcome").agg(F.count("*").alias("n"), F.min("code").alias("first_code"))


ORACLES["q_full_pass"] = f"SELECT outcome, count(*) AS n, min(code) AS first_code FROM ({_CASCADE}) h SEMI JOIN ({ORACLES['q_resume']}) l USING (code, year) GROUP BY outcome"
