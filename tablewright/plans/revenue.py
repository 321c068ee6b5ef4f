"""Breakdowns, plausibility, hard rules and the success rate."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import reconcile as R
from tablewright.plans.base import VIEWS, query

VIEWS["shared"] = """
    SELECT code, year, k, dim, name, amount,
           CASE WHEN k = 1 AND dim = 'regions' THEN NULL ELSE round(CAST(amount AS DOUBLE) / CAST(t AS DOUBLE) * 100 * CASE WHEN k = 3 AND dim = 'regions' THEN 2 WHEN k = 4 AND dim = 'segments' THEN 1.05 ELSE 1 END, 2) END AS ratio
    FROM (SELECT *, sum(amount) OVER (PARTITION BY code, year, dim) AS t FROM golden) g WHERE NOT (k = 2 AND dim = 'segments' AND name LIKE 'S%')"""


@query("q_shares", """
SELECT code, year, dim, name, CAST(amount AS DOUBLE) AS amount,
       round(CAST(amount AS DOUBLE) / CAST(nullif(sum(amount) OVER (PARTITION BY code, year, dim), 0) AS DOUBLE) * 100, 2) AS share_calc,
       CAST(row_number() OVER (PARTITION BY code, year, dim ORDER BY amount DESC, name) AS INT) AS rn FROM pred""")
def shares(load):
    return R.shares(load("pred")).select("code", "year", "dim", "name", F.col("amount").cast("double").alias("amount"), "share_calc", "rn")


CONFIDENCE_SQL = """
WITH s AS (SELECT code, year, dim, sum(amount) AS s FROM pred GROUP BY ALL HAVING sum(amount) <> 0),
j AS (SELECT s.*, CAST(revenue AS DOUBLE) AS revenue, CAST(main_revenue AS DOUBLE) AS main_revenue FROM s LEFT JOIN anchor USING (code, year)),
c AS (SELECT code, year, count(*) AS n_dims,
      count(*) FILTER ((revenue > 0 AND abs(CAST(s AS DOUBLE) - revenue) <= 0.03 * revenue) OR (main_revenue > 0 AND abs(CAST(s AS DOUBLE) - main_revenue) <= 0.03 * main_revenue)) AS dims_hit,
      any_value(revenue) AS revenue, any_value(main_revenue) AS main_revenue FROM j GROUP BY code, year),
conf AS (SELECT *, CASE WHEN revenue IS NULL THEN 'unknown' WHEN dims_hit = n_dims THEN 'high' ELSE 'low' END AS confidence FROM c)
"""


@query("q_plausibility", CONFIDENCE_SQL + "SELECT code, year, n_dims, dims_hit, revenue, main_revenue, confidence FROM conf")
def plausibility(load):
    return R.confidence(load("pred"), load("anchor")).drop("parsed_total")


@query("q_confidence", CONFIDENCE_SQL + """
, far AS (SELECT code, year, CAST(s AS DOUBLE) AS parsed_total, row_number() OVER (PARTITION BY code, year ORDER BY abs(CAST(s AS DOUBLE) - revenue) DESC, dim DESC) AS rn FROM j WHERE revenue IS NOT NULL)
SELECT conf.code, conf.year, confidence, parsed_total FROM conf JOIN far USING (code, year) WHERE rn = 1""")
def confidence(load):
    return R.confidence(load("pred"), load("anchor")).where("confidence <> 'unknown'").select("code", "year", "confidence", "parsed_total")


@query("q_success_rate", CONFIDENCE_SQL + """
, o AS (SELECT 'revenue' AS field, CASE confidence WHEN 'high' THEN 'green' WHEN 'low' THEN 'non_green' ELSE 'no_anchor' END AS outcome FROM conf)
SELECT coalesce(field, 'overall') AS field, count(*) FILTER (outcome = 'green') AS green, count(*) FILTER (outcome = 'non_green') AS non_green, count(*) FILTER (outcome = 'no_anchor') AS no_anchor,
       count(*) FILTER (outcome <> 'no_anchor') AS anchored_denominator,
       round(count(*) FILTER (outcome = 'green') / nullif(count(*) FILTER (outcome <> 'no_anchor'), 0), 3) AS success_rate
FROM o GROUP BY GROUPING SETS ((field), ())""")
def success_rate(load):
    """Overall and by field in one pass: GROUPING SETS by way of rollup on one column."""
    c = R.confidence(load("pred"), load("anchor")).select(F.lit("revenue").alias("field"), F.when(F.col("confidence") == "high", "green").when(F.col("confidence") == "low", "non_green").otherwise("no_anchor").alias("outcome"))
    n = lambda o: F.count_if(F.col("outcome") == o)
    return c.rollup("field").agg(n("green").alias("green"), n("non_green").alias("non_green"), n("no_anchor").alias("no_anchor")).select(
        F.coalesce("field", F.lit("overall")).alias("field"), "green", "non_green", "no_anchor", (F.col("green") + F.col("non_green")).alias("anchored_denominator"),
        F.round(F.try_divide(F.col("green"), F.col("green") + F.col("non_green")), 3).alias("success_rate"),
    )


@query("q_plaus_a", """
WITH d AS (SELECT code, year, dim, count(*) AS n, round(sum(ratio), 6) AS s FROM shared GROUP BY ALL)
SELECT code, year, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_dims, count(*) FILTER (s BETWEEN 97 AND 103) AS ratio_ok_dims,
       count(*) FILTER (s BETWEEN 97 AND 103) = count(*) AND sum(n) >= 2 AS clean FROM d GROUP BY code, year""")
def plaus_a(load):
    return R.share_plausibility(load("shared"))


DETAIL_SQL = """
WITH s AS (SELECT code, year, count(amount) AS n, sum(amount) AS s FROM {items} GROUP BY ALL),
j AS (SELECT t.code, t.year, coalesce(n, 0) AS n_rows, round(abs(CAST(coalesce(s, 0) AS DOUBLE) - CAST(total AS DOUBLE)) / nullif(CAST(total AS DOUBLE), 0) * 100, 4) AS diff_pct, total FROM ({totals}) t LEFT JOIN s USING (code, year))
SELECT code, year, n_rows, diff_pct, coalesce(total > 0 AND n_rows >= 2 AND diff_pct <= 1, false) AS clean FROM j"""


@query("q_plaus_b", DETAIL_SQL.format(items="rnd", totals="SELECT * FROM rnd_total"))
def plaus_b(load):
    return R.detail_plausibility(load("rnd"), load("rnd_total"))


@query("q_plaus_c", """
WITH d AS (SELECT code, year, dim, sum(n) AS s FROM emp GROUP BY ALL)
SELECT code, year, count(*) AS n_dims, count(*) FILTER (abs(s - total) <= 2) AS ok_dims, any_value(total) AS total, any_value(total) > 0 AND count(*) FILTER (abs(s - total) <= 2) = count(*) AS clean
FROM emp_total JOIN d USING (code, year) GROUP BY code, year""")
def plaus_c(load):
    return R.count_plausibility(load("emp"), load("emp_total"))


def share_violations(field: str, view: str, dim: str = "dim") -> str:
    return f"""
    SELECT code, year, '{field}.' || {dim} AS field, 'ratio_range' AS rule, 'red' AS severity, name AS detail FROM {view} WHERE ratio < 0 OR ratio > 100
    UNION ALL SELECT code, year, '{field}.' || dim, 'ratio_sum', CASE WHEN s BETWEEN 90 AND 110 THEN 'warn' ELSE 'red' END, format('{{{{:,.2f}}}}', s)
    FROM (SELECT code, year, {dim} AS dim, count(*) AS n, round(sum(ratio), 2) AS s FROM {view} WHERE ratio BETWEEN 0 AND 100 GROUP BY code, year, {dim}) x WHERE n >= 3 AND s NOT BETWEEN 98 AND 102"""


VIEWS["cost_shared"] = """
    SELECT code, year, k, '_all' AS dim, name, amount, round(CAST(amount AS DOUBLE) / CAST(t AS DOUBLE) * 100 * CASE WHEN k = 4 THEN 0.95 WHEN k = 6 THEN 1.2 ELSE 1 END, 2) AS ratio
    FROM (SELECT *, sum(amount) OVER (PARTITION BY code, year) AS t FROM costs) g WHERE t > 0"""

TOTAL_SQL = """
    SELECT code, year, '{field}' AS field, 'detail_sum' AS rule, CASE WHEN off <= {warn} THEN 'warn' ELSE 'red' END AS severity, format('{{{{:,.2f}}}}', CAST(off AS DOUBLE)) AS detail
    FROM (SELECT code, year, {off} AS off FROM {totals} JOIN (SELECT code, year, sum(amount) AS s FROM ({items}) i GROUP BY ALL) s USING (code, year) WHERE total > 0) x WHERE off > {clean}"""
_RND = TOTAL_SQL.format(field="rnd_info", clean=1, warn=5, off="round(abs(CAST(s AS DOUBLE) - CAST(total AS DOUBLE)) / CAST(total AS DOUBLE) * 100, 2)", totals="rnd_total", items="SELECT * FROM rnd")
_EMP = " UNION ALL ".join(TOTAL_SQL.format(field=f"employees.{d}", clean=0, warn=2, off="abs(CAST(s AS DOUBLE) - CAST(total AS DOUBLE))", totals="emp_total", items=f"SELECT code, year, n AS amount FROM emp WHERE dim = ''{d}''".replace("''", "'")) for d in ("composition", "education"))
_REV, _COST = share_violations("revenue_breakdown", "shared"), share_violations("cost_breakdown", "cost_shared")


def _fix(sql: str) -> str:
    return sql.replace("{{", "{").replace("}}", "}")


def _employees(load):
    emp = load("emp").withColumn("amount", F.col("n"))
    parts = [R.violations_of_total(emp.where(F.col("dim") == d), load("emp_total"), f"employees.{d}", 0, 2, False) for d in ("composition", "education")]
    return parts[0].unionByName(parts[1])


@query("q_hard_revenue", _fix(_REV))
def hard_revenue(load):
    return R.violations_of_shares(load("shared"), "revenue_breakdown")


@query("q_hard_cost", _fix(_COST))
def hard_cost(load):
    return R.violations_of_shares(load("cost_shared"), "cost_breakdown")


@query("q_hard_rnd", _fix(_RND))
def hard_rnd(load):
    return R.violations_of_total(load("rnd"), load("rnd_total"), "rnd_info", 1, 5, True)


@query("q_hard_employees", _fix(_EMP))
def hard_employees(load):
    return _employees(load)


VIOLATIONS_SQL = f"WITH v AS ({_fix(_REV)} UNION ALL {_fix(_COST)} UNION ALL {_fix(_RND)} UNION ALL {_fix(_EMP)})"


@query("q_hard_rules", VIOLATIONS_SQL + """
SELECT r.code, r.year, count(*) FILTER (severity = 'red') AS red_count, count(*) FILTER (severity = 'warn') AS warn_count,
       coalesce(string_agg(DISTINCT split_part(field, '.', 1), ',' ORDER BY split_part(field, '.', 1)) FILTER (severity = 'red'), '') AS red_fields,
       count(*) FILTER (severity = 'red') = 0 AS passed
FROM reports r LEFT JOIN v USING (code, year) GROUP BY r.code, r.year""")
def hard_rules(load):
    return R.hard_rules(load("reports"), hard_revenue(load), hard_cost(load), hard_rnd(load), _employees(load))
