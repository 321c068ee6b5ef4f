"""Whole parses of reports, their routing, and plug-ins in child processes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators import grid as G
from tablewright.operators import isolated
from tablewright.operators import reconcile as R
from tablewright.operators import reports as P
from tablewright.operators import routing, selection
from tablewright.plans import fieldtables, grids, variants
from tablewright.plans.base import ORACLES, VIEWS, query
from tablewright.plans.selections import QUESTION, SELECTED
from tablewright.plans.variants import _TOTAL, _money
from tablewright.session import kept

#: A reviewer chose the margin table of these reports; a rule sets the unit of those.
VIEWS["forced_tables"] = "SELECT code, year, CAST(2 AS INT) AS table_id FROM reports WHERE k = 2"
VIEWS["unit_rules"] = "SELECT code, year, CASE WHEN year % 2 = 0 THEN 10000 ELSE 7 END AS unit FROM reports WHERE k = 4"

_EXACT = "CASE " + " ".join(f"WHEN list_contains(x, '{m}') THEN '{d}'" for m, d in G.DIMENSIONS.items()) + " END"
_LOOSE = "CASE " + " ".join(f"WHEN len(list_filter(x, lambda y: ends_with(y, '{m}') AND length(y) <= {len(m) + 6})) > 0 THEN '{d}'" for m, d in G.DIMENSIONS.items()) + " END"


def _parse_sql(chosen: str) -> str:
    """From the chosen tables (sel: code, year, table_id, hint, via) to their items (k2)."""
    return f"""{chosen},
 ch AS MATERIALIZED (SELECT code, year, table_id, r, c, v, hint FROM all_cells JOIN sel USING (code, year, table_id)),
 {grids.HEADCOLS[5:].replace("FROM cells", "FROM ch")}, {grids.FALLBACK}, hi AS (SELECT code, year, table_id, any_value(hint) AS hint FROM ch GROUP BY ALL),
 nq AS (SELECT code, year, table_id, coalesce(name, t, 0) AS nc, revenue, m, CASE WHEN revenue IS DISTINCT FROM ratio THEN ratio END AS qc FROM cols JOIN fb USING (code, year, table_id)),
 rs AS (SELECT code, year, table_id, nc, coalesce(revenue, hint, list_filter(m, lambda x: x <> nc AND x IS DISTINCT FROM qc)[1]) AS ac FROM nq JOIN hi USING (code, year, table_id)),
 un AS (SELECT code, year, CASE WHEN unit = 10000 THEN 10000.0 ELSE 1.0 END AS unit FROM reports LEFT JOIN unit_rules USING (code, year)),
 rl0 AS (SELECT code, year, table_id, r, list(trim(replace(coalesce(v, ''), chr(10), '')) ORDER BY c) AS x FROM ch GROUP BY ALL),
 mk AS (SELECT *, coalesce({_EXACT}, CASE WHEN len(list_filter(x, lambda y: ({_money('y')}) IS NOT NULL)) = 0 THEN {_LOOSE} END) AS marker FROM rl0),
 dm AS (SELECT *, last_value(marker IGNORE NULLS) OVER (PARTITION BY code, year, table_id ORDER BY r) AS lm, max(marker IS NOT NULL) OVER (PARTITION BY code, year, table_id) AS any_marker FROM mk),
 fl AS (SELECT dm.*, nc, ac, unit, list_filter(x, lambda y: y <> '') AS f FROM dm JOIN rs USING (code, year, table_id) JOIN un USING (code, year) WHERE marker IS NULL),
 wd AS (SELECT *, list_filter(string_split(f[1], ' '), lambda y: y <> '') AS w, coalesce(x[ac + 1], '') AS am FROM fl WHERE len(f) > 0),
 nm AS (SELECT code, year, table_id, r, coalesce(lm, 'segments') AS dim, lm IS NULL AND any_marker AS before_first, unit, CASE WHEN len(f) <= 2 THEN w[1] ELSE x[nc + 1] END AS name,
   CASE WHEN len(f) <= 2 THEN list_filter(list_transform(w[2:], lambda y: {_money('y')}), lambda y: y IS NOT NULL)[1] WHEN NOT contains(am, '%') THEN {_money('am')} END AS amount FROM wd),
 it AS (SELECT code, year, table_id, r, dim, trim(string_split(name, '  ')[1])[:120] AS name, round(amount * unit, 2) AS amount FROM nm WHERE name <> '' AND name NOT IN ('项目', '项 目') AND NOT {_TOTAL} AND NOT (before_first AND replace(name, ' ', '') IN ('其他业务', '其他业务收入'))),
 k1 AS MATERIALIZED ({grids.CHILDREN_SQL.replace("FROM nested", "FROM it")}),
 k2 AS MATERIALIZED ({grids.PARENTS_SQL.replace("FROM nested WHERE name NOT LIKE '其中%'", "FROM k1")})"""


PARSED = _parse_sql(f"""{SELECTED},
 sel AS (SELECT sl.code, sl.year, sl.table_id, sl.c AS hint, CASE tier WHEN 0 THEN 'anchor+dims' WHEN 1 THEN 'anchor' WHEN 2 THEN 'nearest' ELSE 'recall' END AS via FROM sl JOIN reports USING (code, year) WHERE rn = 1 AND k <> 2
  UNION ALL SELECT jd.code, jd.year, jd.table_id, jd.c, 'llm_select' FROM jd JOIN forced_tables USING (code, year, table_id))""") + """,
 ps AS (SELECT r.code, r.year, CASE WHEN sel.table_id IS NULL THEN 'no_table_found' ELSE 'ok' END AS status, via, sel.table_id, dim, CAST(row_number() OVER (PARTITION BY r.code, r.year, dim ORDER BY k2.r) - 1 AS INT) AS idx, name, CAST(amount AS DECIMAL(20,2)) AS amount
  FROM reports r LEFT JOIN sel USING (code, year) LEFT JOIN k2 USING (code, year, table_id))"""


def parsed(load):
    return P.parse(load("reports"), load("all_cells"), load("table_meta"), load("anchor"), QUESTION, load("forced_tables"), load("unit_rules")).withColumn("amount", F.col("amount").cast("decimal(20,2)"))


@query("q_revenue_breakdown", f"""WITH {PARSED} SELECT code, year, status, via, dim, name, CAST(amount AS DOUBLE) AS amount,
 CASE WHEN dim IS NOT NULL THEN round(CAST(amount AS DOUBLE) / CAST(nullif(sum(amount) OVER (PARTITION BY code, year, dim), 0) AS DOUBLE) * 100, 2) END AS share_calc,
 CASE WHEN dim IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY code, year, dim ORDER BY amount DESC, name) AS INT) END AS rn FROM ps""")
def revenue_breakdown(load):
    """From the grids of all tables to each report's revenue by dimension: choice, unit, columns, rows, folds, shares."""
    out = R.shares(parsed(load))
    return out.select("code", "year", "status", "via", "dim", "name", F.col("amount").cast("double").alias("amount"), "share_calc", F.when(F.col("dim").isNotNull(), F.col("rn")).alias("rn"))


@query("q_parse_status", f"WITH {PARSED} SELECT status, coalesce(via, 'none') AS via, count(DISTINCT (code, year)) AS n_reports, count(dim) AS n_items FROM ps GROUP BY ALL")
def parse_status(load):
    """How the tables of all reports were chosen, and what they gave."""
    one = parsed(load).groupBy("code", "year", "status", "via").agg(F.count("dim").alias("n"))
    return one.groupBy("status", F.coalesce("via", F.lit("none")).alias("via")).agg(F.count("*").alias("n_reports"), F.sum("n").alias("n_items"))


#: What is known of a report for each field: an anchor, the main-business anchor and a total.
VIEWS["field_truths"] = """
    SELECT 'revenue_breakdown' AS field, code, year, revenue AS anchor, main_revenue AS main, CAST(NULL AS DECIMAL(20,2)) AS total FROM anchor
    UNION ALL SELECT 'cost_breakdown', code, year, cost, NULL, NULL FROM anchor
    UNION ALL SELECT 'rnd_info', code, year, rnd_expense, NULL, NULL FROM anchor WHERE year % 2 = 1
    UNION ALL SELECT 'rnd_info', a.code, a.year, rnd_expense, NULL, total FROM anchor a JOIN rnd_total t ON t.code = a.code AND t.year = a.year WHERE a.year % 2 = 0
    UNION ALL SELECT 'employees', code, year, NULL, NULL, CAST(total AS DECIMAL(20,2)) FROM emp_total"""

#: Candidates in order of preference: field, parser, its query, and the SQL of its dimension, name, amount and share.
PARSERS = [
    ("revenue_breakdown", "default", None, "dim", "name", "amount", "NULL"),
    ("revenue_breakdown", "buckets", "q_v_buckets", "dim", "name", "amount", "ratio"),
    ("revenue_breakdown", "two_years", "q_v_two_years", "dim", "name", "amount", "ratio"),
    ("cost_breakdown", "default", "q_cost_breakdown", "'costs'", "item", "amount_yuan", "ratio_pct"),
    ("cost_breakdown", "flat_costs", "q_v_costs", "dim", "name", "amount", "ratio"),
    ("rnd_info", "rnd_details", "q_v_rnd", "dim", "name", "amount", "NULL"),
    ("employees", "staff_lists", "q_v_staff", "dim", "name", "amount", "NULL"),
]
_FOUND = " UNION ALL ".join(
    f"SELECT '{f}' AS field, '{s}' AS source, {k} AS ord, code, year, {d} AS dim, {n} AS name, CAST({a} AS DECIMAL(20,2)) AS amount, CAST({q} AS DOUBLE) AS ratio FROM {'ps' if o is None else '(' + ORACLES[o] + ')'} o{k} WHERE {d} IS NOT NULL"
    for k, (f, s, o, d, n, a, q) in enumerate(PARSERS)
)
_NEAR = "coalesce({1} > 0 AND abs(CAST({0} AS DOUBLE) - CAST({1} AS DOUBLE)) <= 0.03 * CAST({1} AS DOUBLE), false)"
ROUTED = f"""WITH {PARSED}, cd AS MATERIALIZED ({_FOUND}),
 dq AS (SELECT field, source, ord, code, year, dim, count(*) AS n, count(amount) AS na, sum(amount) AS s, round(sum(ratio), 2) AS q FROM cd GROUP BY ALL),
 jq AS (SELECT dq.*, anchor, main, total, field IN ('revenue_breakdown', 'cost_breakdown') AS is_a FROM dq LEFT JOIN field_truths USING (field, code, year)),
 pl AS (SELECT field, source, ord, code, year, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_dims, count(*) FILTER (CASE WHEN is_a THEN q BETWEEN 97 AND 103 WHEN field = 'employees' THEN total > 0 AND abs(s - total) <= 2 END) AS ok_dims,
   CASE WHEN any_value(anchor) IS NULL THEN 'unknown' WHEN count(*) FILTER (s <> 0) > 0 AND bool_and({_NEAR.format("s", "anchor")} OR {_NEAR.format("s", "main")}) FILTER (s <> 0) THEN 'high' ELSE 'low' END AS confidence,
   sum(CAST(s AS DOUBLE)) FILTER (dim <> 'total') AS ds, sum(na) FILTER (dim <> 'total') AS dn, CAST(any_value(total) AS DOUBLE) AS total FROM jq GROUP BY ALL),
 jd2 AS (SELECT *, CASE field WHEN 'rnd_info' THEN coalesce(total > 0 AND dn >= 2 AND abs(ds - total) <= total * 0.01, false) WHEN 'employees' THEN ok_dims = n_dims ELSE (ok_dims = n_dims AND n_rows >= 2) OR confidence = 'high' END AS clean FROM pl),
 rt AS (SELECT *, row_number() OVER (PARTITION BY field, code, year ORDER BY clean DESC, ok_dims DESC, n_rows DESC, ord) AS rn, count(*) OVER (PARTITION BY field, code, year) AS n_tried FROM jd2)"""


#: Parsers that read the same cells, in the order of PARSERS.
_JOBS = (1, 2, 1, 3)


def _candidates(load):
    """Parsers of the same cells are one job, the jobs follow each other: cells are dealt once for a job, its plan is small, and its shuffle
    files have gone before the next one begins. All parsers as one plan held the driver's memory and every shuffle until the end."""
    found = {
        ("revenue_breakdown", "default"): parsed(load),
        ("revenue_breakdown", "buckets"): variants.buckets(load),
        ("revenue_breakdown", "two_years"): variants.two_years(load),
        ("cost_breakdown", "default"): fieldtables.cost_breakdown(load).select("code", "year", F.lit("costs").alias("dim"), F.col("item").alias("name"), F.col("amount_yuan").alias("amount"), F.col("ratio_pct").alias("ratio")),
        ("cost_breakdown", "flat_costs"): variants.flat_costs(load),
        ("rnd_info", "rnd_details"): variants.rnd_details(load).drop("ratio"),
        ("employees", "staff_lists"): variants.staff_lists(load).drop("ratio"),
    }
    keys, jobs, at = list(found), [], 0
    for n in _JOBS:
        jobs.append(kept(routing.candidates({k: found[k] for k in keys[at : at + n]}, at), "candidates"))
        at += n
    return reduce(DataFrame.unionByName, jobs)


@query("q_field_plausibility", ROUTED + " SELECT field, source, code, year, n_rows, n_dims, ok_dims, confidence, clean FROM jd2")
def field_plausibility(load):
    """Every candidate of every field judged by the rule of its class."""
    return routing.plausibility(_candidates(load), load("field_truths")).drop("ord")


@query("q_route_field", ROUTED + " SELECT field, code, year, CASE WHEN clean THEN 'routed' ELSE 'needs_repair' END AS status, CASE WHEN clean THEN source END AS source, n_tried FROM rt WHERE rn = 1")
def route_field(load):
    """All parsers on all reports, and which of them each field of each report is routed to."""
    return routing.route(routing.plausibility(_candidates(load), load("field_truths")))


OVER = _parse_sql(f"""{SELECTED.replace("recall <= 8", "recall <= 12")}, tried AS (SELECT code, year, page FROM sl JOIN table_meta USING (code, year, table_id) WHERE rn = 1),
 sel AS (SELECT rl.code, rl.year, rl.table_id, recall, jd.c AS hint, 'over' AS via FROM rl JOIN jd USING (code, year, table_id) JOIN table_meta USING (code, year, table_id) ANTI JOIN tried USING (code, year, page) WHERE recall <= 12 AND NOT jd.trap)""").replace("FROM reports LEFT JOIN unit_rules USING (code, year)", "FROM (SELECT code, year, 1 AS unit FROM reports) q") + f""",
 os AS (SELECT code, year, table_id, dim, sum(CAST(amount AS DECIMAL(20,2))) AS s FROM k2 GROUP BY ALL HAVING sum(CAST(amount AS DECIMAL(20,2))) <> 0),
 hg AS (SELECT code, year, table_id FROM os JOIN anchor USING (code, year) GROUP BY ALL HAVING bool_and({_NEAR.format("s", "revenue")} OR {_NEAR.format("s", "main_revenue")})),
 pc AS (SELECT code, year, table_id, CAST(recall AS INT) AS recall, CAST(row_number() OVER (PARTITION BY code, year ORDER BY recall) AS INT) AS place FROM hg JOIN sel USING (code, year, table_id))"""


@query("q_over_anchor", f"WITH {OVER} SELECT * FROM pc WHERE place <= 4")
def over_anchor(load):
    """Other recalled tables that, parsed, meet the anchor: what a second choice may be made from."""
    cells, meta, anchors = load("all_cells"), load("table_meta"), load("anchor")
    tables = selection.judged(cells, anchors, meta)
    first = selection.selected(selection.recalled_tables(G.text_doc(cells, meta), QUESTION, 12), tables)
    tried = first.join(meta, list(G.TABLE)).select("code", "year", "page")
    return P.over_anchor(cells, meta, anchors, QUESTION, tried)


#: Plug-ins of three kinds, as text that a child process runs: one that is sound, one that never ends for some reports, one that ends its process.
PLUGINS = {
    "sound": """
def parse(tables, context=None):
    for t in tables:
        rows = []
        for row in t["grid"]:
            try:
                rows.append({"name": row[0], "revenue_yuan": float(row[1].replace(",", ""))})
            except (ValueError, IndexError):
                continue
        if len(rows) >= 3:
            return {"segments": rows}
    return {}
""",
    "endless": """
def parse(tables, context=None):
    n = int(tables[2]["grid"][-1][1])
    while n % 41 == 0:
        pass
    return {"segments": [{"name": "last", "revenue_yuan": n}]}
""",
    "crashing": """
import os
def parse(tables, context=None):
    n = int(tables[2]["grid"][-1][1])
    if n % 37 == 0:
        os._exit(3)
    if n % 5 == 0:
        raise ValueError(n)
    return {"segments": [{"name": "last", "revenue_yuan": n}]}
""",
}
_LAST = "(SELECT code, year, arg_max(n, (-n, dim, name)) AS n FROM emp GROUP BY ALL)"


@query("q_isolated_plugins", f"""WITH nums AS (SELECT code, year, table_id, count(*) AS n_rows, sum(CAST({_money("coalesce(v, '')")} AS DECIMAL(20,2))) AS s FROM cells WHERE c = 1 AND ({_money("coalesce(v, '')")}) IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
 f AS (SELECT code, year, min(table_id) AS table_id FROM nums GROUP BY ALL), g AS (SELECT * FROM f JOIN nums USING (code, year, table_id)), l AS {_LAST}
SELECT r.code, r.year, 'sound' AS plugin, CASE WHEN g.n_rows IS NULL THEN 'empty' ELSE 'ok' END AS status, coalesce(n_rows, 0) AS n_rows, CAST(s AS DOUBLE) AS total FROM reports r LEFT JOIN g USING (code, year)
UNION ALL SELECT code, year, 'endless', CASE WHEN n % 41 = 0 THEN 'timeout' ELSE 'ok' END, CASE WHEN n % 41 = 0 THEN 0 ELSE 1 END, CASE WHEN n % 41 <> 0 THEN CAST(n AS DOUBLE) END FROM l
UNION ALL SELECT code, year, 'crashing', CASE WHEN n % 37 = 0 THEN 'crash' WHEN n % 5 = 0 THEN 'error' ELSE 'ok' END, CASE WHEN n % 37 = 0 OR n % 5 = 0 THEN 0 ELSE 1 END, CASE WHEN n % 37 <> 0 AND n % 5 <> 0 THEN CAST(n AS DOUBLE) END FROM l""")
def isolated_plugins(load):
    """Plug-ins over all reports, each report within a second: what they give, and how they end."""
    found = isolated.run(isolated.report_tables(load("cells")), PLUGINS, limit=1.0)
    amount = F.col("amount").cast("decimal(20,2)")
    return found.groupBy("code", "year", "plugin", "status").agg(F.count("name").alias("n_rows"), F.sum(amount).cast("double").alias("total"))
