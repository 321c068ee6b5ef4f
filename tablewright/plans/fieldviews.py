"""Grids of costs (table 4), R&D (5), staff (6), clients (7) and their summary (8), suppliers (9) and theirs (10)."""

from __future__ import annotations

from tablewright.plans.base import VIEWS

VIEWS["partners"] = """
    SELECT code, year, side, id, amount, t, CAST(row_number() OVER (PARTITION BY code, year, side ORDER BY amount DESC, id) AS INT) AS rn FROM (
      SELECT *, sum(amount) OVER (PARTITION BY code, year, side) AS t FROM (
        SELECT code, year, 7 AS side, c_custkey AS id, CAST(round(sum(amt), 2) AS DECIMAL(20,2)) AS amount FROM fact GROUP BY code, year, c_custkey
        UNION ALL SELECT code, year, 9, l_partkey, CAST(round(sum(cst), 2) AS DECIMAL(20,2)) FROM fact GROUP BY code, year, l_partkey) p) q"""
_NIL = "CAST(0 AS DECIMAL(20,2))"
_PCT = "concat(CAST(CAST(@places2({0} * 100 / {1}) AS DECIMAL(10,2)) AS STRING), '%')"
VIEWS["field_rows"] = f"""
    SELECT code, year, table_id, CAST(row_number() OVER (PARTITION BY code, year, table_id ORDER BY part, amount DESC, name) - 1 AS INT) AS r, c0, c1, c2, c3, c4, c5, c6 FROM (
      SELECT code, year, 4 AS table_id, 0 AS part, {_NIL} AS amount, '' AS name, '行业分类' AS c0, '项目' AS c1, '金额' AS c2, CASE WHEN k = 1 THEN '占比' ELSE '占营业成本比重' END AS c3, '金额' AS c4, '占比' AS c5, '同比增减' AS c6 FROM reports
      UNION ALL SELECT code, year, 4, 1, amount, name, CASE WHEN k = 3 AND name LIKE '%1' THEN '' ELSE '制造业' END, concat('料', name), @money(amount), {_PCT.format("amount", "t")}, @money(amount - 1), CASE WHEN k = 4 THEN NULL ELSE '12.50%' END, CASE WHEN k % 2 = 0 THEN '-1.25%' END FROM (SELECT *, sum(amount) OVER (PARTITION BY code, year) + 1 AS t FROM costs) c
      UNION ALL SELECT code, year, 5, 0, {_NIL}, '', '项 目', '本期发生额', '上期发生额', NULL, NULL, NULL, NULL FROM reports
      UNION ALL SELECT code, year, 5, 1, amount, name, concat('研发费用', name), @money(amount), CASE WHEN k = 1 THEN '' ELSE @money(amount - 1) END, CASE WHEN k = 2 THEN @money(amount * 2) END, NULL, NULL, NULL FROM rnd
      UNION ALL SELECT code, year, 5, 2, {_NIL}, '', '合计', @money(total), @money(total - 1), NULL, NULL, NULL, NULL FROM rnd_total
      UNION ALL SELECT code, year, 6, 0, {_NIL}, '', '母公司在职员工的数量（人）', CAST(total - 1 AS STRING), NULL, NULL, NULL, NULL, NULL FROM emp_total
      UNION ALL SELECT code, year, 6, 1, {_NIL}, '', '在职员工的数量合计（人）', concat('1,', substring(CAST(1000 + total AS STRING), 2, 3)), NULL, NULL, NULL, NULL, NULL FROM emp_total
      UNION ALL SELECT code, year, 6, 2 + 3 * d, {_NIL}, '', CASE d WHEN 0 THEN '专业构成' ELSE '教育程度' END, NULL, NULL, NULL, NULL, NULL, NULL FROM reports CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1) x
      UNION ALL SELECT code, year, 6, 3 + 3 * CASE dim WHEN 'composition' THEN 0 ELSE 1 END, {_NIL}, name, concat('类', name), CAST(n AS STRING), NULL, NULL, NULL, NULL, NULL FROM emp
      UNION ALL SELECT code, year, 6, 4 + 3 * d, {_NIL}, '', '合计', '99', NULL, NULL, NULL, NULL, NULL FROM reports CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1) x
      UNION ALL SELECT code, year, side, 0, {_NIL}, '', '序号', CASE side WHEN 7 THEN '客户名称' ELSE '供应商名称' END, CASE side WHEN 7 THEN '销售额（元）' ELSE '采购额（元）' END, '占比', NULL, NULL, NULL FROM reports CROSS JOIN (SELECT 7 AS side UNION ALL SELECT 9) x
      UNION ALL SELECT code, year, side, rn, {_NIL}, '', CAST(rn AS STRING), CASE WHEN id % 5 = 0 THEN '--' ELSE concat('户', CAST(id AS STRING)) END, @money(amount), {_PCT.format("amount", "t")}, NULL, NULL, NULL FROM partners WHERE rn <= 5
      UNION ALL SELECT code, year, side + 1, 0, {_NIL}, '', CASE side WHEN 7 THEN '前五名客户合计销售金额（元）' ELSE '前五名供应商合计采购金额（元）' END, @money(s), NULL, NULL, NULL, NULL, NULL FROM (SELECT code, year, side, sum(amount) AS s, max(t) AS t FROM partners WHERE rn <= 5 GROUP BY code, year, side) p
      UNION ALL SELECT code, year, side + 1, 1, {_NIL}, '', CASE side WHEN 7 THEN '前五名客户合计销售金额占年度销售总额比例' ELSE '前五名供应商合计采购金额占年度采购总额比例' END, {_PCT.format("s", "t")}, NULL, NULL, NULL, NULL, NULL FROM (SELECT code, year, side, sum(amount) AS s, max(t) AS t FROM partners WHERE rn <= 5 GROUP BY code, year, side) p
      UNION ALL SELECT code, year, side + 1, 2, {_NIL}, '', CASE side WHEN 7 THEN '前五名客户销售额中关联方销售额占年度销售总额比例' ELSE '前五名供应商采购额中关联方采购额占年度采购总额比例' END, '3.50%', NULL, NULL, NULL, NULL, NULL FROM reports CROSS JOIN (SELECT 7 AS side UNION ALL SELECT 9) x) y"""
VIEWS["field_cells"] = """
    SELECT code, year, table_id, r, c, CASE c WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 WHEN 3 THEN c3 WHEN 4 THEN c4 WHEN 5 THEN c5 ELSE c6 END AS v
    FROM field_rows CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6) n WHERE c < 4 OR table_id = 4"""
