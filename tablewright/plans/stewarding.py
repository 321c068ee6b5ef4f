"""Failures by layer and rates by field, from what the parsers of this engine give."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import dossiers as D
from tablewright.operators import routing
from tablewright.operators import selection as S
from tablewright.operators.grid import TABLE, text_doc
from tablewright.plans import ledgers, rollups  # noqa: F401  (define the views verdicts and annual)
from tablewright.plans import parsing, selections
from tablewright.plans.base import query
from tablewright.session import kept

_HIT = f"({parsing._NEAR.format('s', 'revenue')} OR {parsing._NEAR.format('s', 'main_revenue')})"
DOSSIERS = parsing.ROUTED + f""",
 xr AS (SELECT code, year, table_id, r, bool_or(coalesce(regexp_matches(v, '[0-9]'), false)) AS dg, bool_or(coalesce(regexp_matches(v, '[一-鿿]'), false)) AS tx, bool_or(coalesce(regexp_matches(v, '{"|".join(D.MARKERS)}'), false)) AS mk FROM all_cells GROUP BY ALL),
 xt AS (SELECT code, year, table_id, count(*) FILTER (dg AND tx) AS nd FROM xr GROUP BY ALL HAVING bool_or(mk)), xe AS (SELECT code, year, count(*) AS n_marked, bool_or(nd >= 3) AS extracted FROM xt GROUP BY ALL),
 pd0 AS (SELECT code, year, dim, sum(amount) AS s FROM ps WHERE dim IS NOT NULL GROUP BY ALL), pp AS (SELECT code, year, count(*) AS n_dims, count(*) FILTER {_HIT.join(("(", ")"))} AS n_hit FROM pd0 LEFT JOIN anchor USING (code, year) GROUP BY ALL),
 fr AS (SELECT code, year FROM reports r WHERE NOT EXISTS (SELECT 1 FROM rt WHERE rt.code = r.code AND rt.year = r.year AND field = 'revenue_breakdown' AND rn = 1 AND clean)),
 s1 AS (SELECT code, year, table_id, rel, CASE tier WHEN 0 THEN 'anchor+dims' WHEN 1 THEN 'anchor' WHEN 2 THEN 'nearest' ELSE 'recall' END AS via FROM sl WHERE rn = 1),
 do1 AS (SELECT fr.code, fr.year, table_id, via, rel, coalesce(rel <= 0.05, false) AS anchor_matches, coalesce(n_marked, 0) AS n_marked, coalesce(extracted, false) AS extracted, coalesce(n_dims, 0) AS n_dims, coalesce(n_hit, 0) AS n_hit, coalesce(revenue, 0) <> 0 AS known
  FROM fr LEFT JOIN s1 USING (code, year) LEFT JOIN xe USING (code, year) LEFT JOIN pp USING (code, year) LEFT JOIN anchor USING (code, year)),
 dos AS (SELECT code, year, table_id, via, rel, anchor_matches, n_marked, extracted, n_dims, n_hit, CASE WHEN NOT extracted THEN 'extraction' WHEN NOT known THEN 'anchor' WHEN NOT anchor_matches THEN 'selection' WHEN n_hit < n_dims OR n_dims = 0 THEN 'parse' ELSE 'data' END AS layer FROM do1)"""


def _dossiers(load):
    cells, meta, anchors = load("all_cells"), load("table_meta"), load("anchor")
    # files: read twice, for the routes, and the default's rows for the probe of parses
    items = parsing._candidates(load)
    routes = routing.route(routing.plausibility(items, load("field_truths")))
    routed = routes.where("field = 'revenue_breakdown' and status = 'routed'")
    failed = kept(load("reports").select("code", "year").join(routed, ["code", "year"], "left_anti"), "failed")
    mine = lambda df: df.join(failed, ["code", "year"], "left_semi")
    # probes look at failed reports only, whose cells are dealt by report once for all of them
    cells = mine(cells.select(*TABLE, "r", "c", "v").repartition("code", "year"))
    chosen = S.selected(S.recalled_tables(text_doc(cells, meta), selections.QUESTION), S.judged(cells, anchors, meta, dealt=True))
    parse = D.parse_probe(mine(items.where("field = 'revenue_breakdown' and source = 'default'")), anchors)
    return D.dossiers(failed, chosen, D.extraction_probe(cells), parse, anchors)


@query("q_dossier", DOSSIERS + " SELECT * FROM dos")
def dossier(load):
    """Every failed report with what selection, extraction and parse found, and the layer that gave way."""
    return _dossiers(load)


@query("q_steward_review", DOSSIERS + " SELECT layer, count(*) AS n, CAST(count(*) FILTER (extracted) AS BIGINT) AS n_extracted, min(code) AS first_code FROM dos GROUP BY ALL")
def steward_review(load):
    """The tail of failures by layer, as a road-map of repairs needs it."""
    return _dossiers(load).groupBy("layer").agg(F.count("*").alias("n"), F.count_if("extracted").alias("n_extracted"), F.min("code").alias("first_code"))


_COUNTS = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in D.OUTCOMES)
_IN = lambda names: "(" + ", ".join(f"'{o}'" for o in names) + ")"
OUTCOMES = parsing.ROUTED + """, fo AS (SELECT f.field, r.code, r.year, CASE WHEN f.field = 'revenue_breakdown' AND coalesce(regexp_matches(name, '银行|证券|信托|保险|期货'), false) THEN 'out_of_scope' WHEN rt.source IS NULL THEN 'no_data'
   WHEN clean AND verdict = 'pass' THEN 'committed' WHEN clean AND verdict = 'hold' THEN 'verify_hold' WHEN clean THEN 'green' WHEN verdict = 'wrong_table' THEN 'no_such_table' WHEN confidence = 'unknown' THEN 'no_anchor' ELSE 'non_green' END AS outcome
  FROM reports r CROSS JOIN (SELECT unnest(['revenue_breakdown', 'cost_breakdown', 'rnd_info', 'employees']) AS field) f LEFT JOIN (SELECT * FROM rt WHERE rn = 1) rt ON rt.field = f.field AND rt.code = r.code AND rt.year = r.year
  LEFT JOIN verdicts v ON v.code = r.code AND v.year = r.year LEFT JOIN annual a ON a.code = r.code AND a.year = r.year)"""


def _outcomes(load):
    return D.outcomes(load("reports"), routing.plausibility(parsing._candidates(load), load("field_truths")), load("verdicts"), load("annual"))


@query("q_field_outcomes", OUTCOMES + " SELECT * FROM fo")
def field_outcomes(load):
    """How every field of every report ended."""
    return _outcomes(load)


@query("q_field_rates", f"{OUTCOMES} SELECT coalesce(field, 'overall') AS field, {_COUNTS}, count(*) FILTER (outcome IN {_IN(D.DENOMINATOR)}) AS anchored_denominator, round(count(*) FILTER (outcome IN {_IN(D.SUCCESS)}) / nullif(count(*) FILTER (outcome IN {_IN(D.DENOMINATOR)}), 0), 3) AS success_rate FROM fo GROUP BY GROUPING SETS ((field), ())")
def field_rates(load):
    """All outcomes by field and overall, with the rate of success."""
    return D.rates(_outcomes(load))
