"""Scores of parser versions against golden breakdowns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.operators import reconcile as R
from tablewright.operators import scoring as S
from tablewright.plans.base import VIEWS, query

VIEWS["versions"] = """
    SELECT 'base' AS version, 0 AS ord, code, year, dim, name, amount, 0 AS idx FROM pred
    UNION ALL SELECT 'fixed', 1, code, year, dim, name, amount, 0 FROM golden WHERE NOT (k = 4 AND dim = 'regions')
    UNION ALL SELECT 'fixed', 1, code, year, dim, concat(name, ' '), CAST(amount + 1 AS DECIMAL(20,2)), 1 FROM golden WHERE k = 1 AND dim = 'segments'
    UNION ALL SELECT 'off', 2, code, year, dim, concat(' ', name), CAST(amount * CAST(1.02 AS DECIMAL(3,2)) AS DECIMAL(20,2)), 0 FROM golden WHERE dim <> 'by_channel' OR year % 2 = 0"""
VIEWS["truths"] = """
    SELECT v.version, v.ord, code, year, dim, name, amount, 0 AS idx FROM golden
    CROSS JOIN (SELECT 'base' AS version, 0 AS ord UNION ALL SELECT 'fixed', 1 UNION ALL SELECT 'off', 2) v WHERE k <> 6"""
VIEWS["rnd_golden"] = """
    SELECT v.version, g.code, g.year, g.name, g.amount, 0 AS idx FROM (SELECT code, year, l_returnflag AS name, CAST(round(sum(tax), 2) AS DECIMAL(20,2)) AS amount FROM fact GROUP BY code, year, l_returnflag) g
    CROSS JOIN (SELECT 'a' AS version UNION ALL SELECT 'b') v"""
VIEWS["rnd_pred"] = """
    SELECT 'a' AS version, code, year, name, amount, 0 AS idx FROM rnd UNION ALL SELECT 'b', code, year, name, CAST(amount * CAST(1.005 AS DECIMAL(4,3)) AS DECIMAL(20,2)), 0 FROM rnd WHERE name <> 'N' OR year % 2 = 1"""
VIEWS["rnd_golden_total"] = "SELECT v.version, code, year, total FROM rnd_total CROSS JOIN (SELECT 'a' AS version UNION ALL SELECT 'b') v"
VIEWS["rnd_pred_total"] = "SELECT version, code, year, CAST(sum(amount) AS DECIMAL(20,2)) AS total FROM rnd_pred GROUP BY version, code, year"
VIEWS["emp_golden"] = "SELECT 'a' AS version, code, year, concat(dim, '/', name) AS name, CASE WHEN k = 3 AND name = 'F' AND dim = 'composition' THEN n - 1 WHEN k = 4 AND name = 'F' AND dim = 'composition' THEN n - 9 ELSE n END AS amount, 0 AS idx FROM emp"
VIEWS["emp_pred"] = "SELECT 'a' AS version, code, year, concat(dim, '/', name) AS name, n AS amount, 0 AS idx FROM emp WHERE NOT (k = 2 AND name = 'A')"
VIEWS["emp_totals"] = "SELECT 'a' AS version, code, year, total FROM emp_total"

_NORM = "translate(name, ' 　' || chr(9) || chr(10) || '、,，()（）', '')"


def matched(golden: str, pred: str, by: str) -> str:
    one = f"(SELECT {by}, {_NORM} AS nname, CAST(arg_max(amount, (idx, amount)) AS DOUBLE) AS amount FROM {{0}} GROUP BY ALL)"
    return f"""m AS (SELECT {by}, nname, g.amount AS g, p.amount AS p, g.nname IS NOT NULL AS has_g, p.nname IS NOT NULL AS has_p, g.nname IS NOT NULL AND p.nname IS NOT NULL AS matched,
        coalesce(g.nname IS NOT NULL AND p.nname IS NOT NULL AND abs(g.amount - p.amount) <= 0.01 * greatest(abs(g.amount), abs(p.amount), 1.0), false) AS agree
        FROM {one.format(golden)} g FULL JOIN {one.format(pred)} p USING ({by}, nname))"""


_M = matched("truths", "versions", "version, code, year, dim")
DIMS_SQL = f"""WITH {_M}, d AS (SELECT version, code, year, dim, count(*) FILTER (has_g) AS n_golden, count(*) FILTER (has_p) AS n_pred, count(*) FILTER (matched) AS n_matched, count(*) FILTER (agree) AS n_agree FROM m GROUP BY ALL),
dims AS (SELECT version, code, year, dim, n_golden, n_pred, CASE WHEN n_golden > 0 THEN n_matched / n_golden WHEN n_pred > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS row_recall,
  CASE WHEN n_pred > 0 THEN n_matched / n_pred WHEN n_golden > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS row_precision,
  CASE WHEN n_matched > 0 THEN n_agree / n_matched WHEN n_golden + n_pred > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS value_acc, n_golden + n_pred - n_matched - n_agree AS n_mismatch FROM d)"""
SCORES_SQL = DIMS_SQL + """,
sc0 AS (SELECT version, code, year, round(avg(row_recall * value_acc) * avg(row_precision), 4) AS score, CAST(sum(n_mismatch) AS BIGINT) AS mm FROM dims WHERE n_golden > 0 GROUP BY version, code, year),
sc AS (SELECT version, code, year, score, score >= 0.999 AND mm = 0 AS exact FROM sc0)"""


def _scores(load):
    return S.score_fields(load("truths"), load("versions"))


@query("q_score_dim", DIMS_SQL + " SELECT * FROM dims")
def score_dim(load):
    return S.score_dimensions(load("truths"), load("versions"))


@query("q_score_a", SCORES_SQL + " SELECT * FROM sc")
def score_a(load):
    return _scores(load)


def _totalled(golden, pred, gt, pt):
    return f"""WITH {matched(golden, pred, 'version, code, year')}, n AS (SELECT version, code, year, count(*) FILTER (has_g) AS a, count(*) FILTER (has_p) AS b, count(*) FILTER (agree) AS c FROM m GROUP BY ALL)
    SELECT n.version, n.code, n.year, round((c + CASE WHEN abs(CAST(g.total AS DOUBLE) - CAST(p.total AS DOUBLE)) <= 0.01 * greatest(abs(CAST(g.total AS DOUBLE)), abs(CAST(p.total AS DOUBLE)), 1.0) THEN 1 ELSE 0 END) / (greatest(a, b) + 1), 4) AS score
    FROM n JOIN {gt} g USING (version, code, year) JOIN {pt} p USING (version, code, year)"""


@query("q_score_b", _totalled("rnd_golden", "rnd_pred", "rnd_golden_total", "rnd_pred_total"))
def score_b(load):
    return S.score_with_total(load("rnd_golden"), load("rnd_pred"), load("rnd_golden_total"), load("rnd_pred_total"))


@query("q_score_c", _totalled("emp_golden", "emp_pred", "emp_totals", "emp_totals"))
def score_c(load):
    return S.score_with_total(load("emp_golden"), load("emp_pred"), load("emp_totals"), load("emp_totals"))


@query("q_eval_version", SCORES_SQL + " SELECT version, count(*) AS n, count(*) FILTER (exact) AS exact, round(avg(score), 4) AS mean_score FROM sc GROUP BY version")
def eval_version(load):
    return S.evaluate(_scores(load))


@query("q_leaderboard", SCORES_SQL + ", e AS (SELECT version, count(*) AS n, count(*) FILTER (exact) AS exact, round(avg(score), 4) AS mean_score FROM sc GROUP BY version) SELECT *, CAST(row_number() OVER (ORDER BY mean_score DESC, exact DESC, version) AS INT) AS place FROM e")
def leaderboard(load):
    return S.leaderboard(_scores(load))


_ORD = "CASE version WHEN 'base' THEN 0 WHEN 'fixed' THEN 1 ELSE 2 END"


def _ordered(load):
    return _scores(load).withColumn("ord", F.when(F.col("version") == "base", 0).when(F.col("version") == "fixed", 1).otherwise(2))


@query("q_best_version", SCORES_SQL + f", r AS (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY score DESC, {_ORD}) AS rn FROM sc) SELECT code, year, version, score FROM r WHERE rn = 1")
def best_version(load):
    return S.best_version(_ordered(load))


@query("q_pick_mother", SCORES_SQL + ", e AS (SELECT version, avg(score) AS s FROM sc GROUP BY version) SELECT arg_max(version, (round(s, 4), CASE version WHEN 'base' THEN 0 WHEN 'fixed' THEN -1 ELSE -2 END)) AS mother, round(max(s), 4) AS score FROM e")
def pick_mother(load):
    """The best parser to derive a new one from; of equals the first."""
    e = _ordered(load).groupBy("version").agg(F.round(F.avg("score"), 4).alias("s"), F.min("ord").alias("ord"))
    return e.agg(F.max_by("version", F.struct("s", -F.col("ord"))).alias("mother"), F.max("s").alias("score"))


@query("q_accept", SCORES_SQL + """, j AS (SELECT c.version AS candidate, a.score AS a, c.score AS b FROM sc a JOIN sc c USING (code, year) WHERE a.version = 'base' AND c.version <> 'base')
SELECT candidate, count(*) AS n, round(avg(a), 4) AS base_mean, round(avg(b), 4) AS cand_mean, count(*) FILTER (b < a - 1e-9) AS regressions, avg(b - a) > 1e-6 AND count(*) FILTER (b < a - 1e-9) = 0 AS accepted FROM j GROUP BY candidate""")
def accept(load):
    s = _scores(load)
    return S.accept(s, "base", "fixed").unionByName(S.accept(s, "base", "off"))


@query("q_anchor_score", """WITH s AS (SELECT code, year, dim, sum(amount) AS s FROM pred GROUP BY ALL), j AS (SELECT code, year, CAST(s AS DOUBLE) / CAST(revenue AS DOUBLE) AS rel FROM s JOIN anchor USING (code, year))
SELECT code, year, round(-sum(abs(rel - 1)), 6) AS score, count(*) FILTER (abs(rel - 1) <= 0.03) AS n_ok FROM j GROUP BY code, year""")
def anchor_score(load):
    """How far a report's dimensions are from the anchor in all: what parser search climbs."""
    s = load("pred").groupBy("code", "year", "dim").agg(F.sum("amount").alias("s")).join(load("anchor"), ["code", "year"])
    off = F.abs(F.col("s").cast("double") / F.col("revenue").cast("double") - 1)
    return s.groupBy("code", "year").agg(F.round(-F.sum(off), 6).alias("score"), F.count_if(off <= 0.03).alias("n_ok"))


#: With an anchor a dimension is fine if it meets it, without one if it agrees with the largest.
ROUTE_SQL = """
WITH d AS (SELECT version, ord, code, year, dim, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS s FROM versions GROUP BY ALL),
t AS (SELECT d.*, max(s) OVER (PARTITION BY version, code, year) AS top, CAST(revenue AS DOUBLE) AS a FROM d LEFT JOIN anchor USING (code, year)),
p AS (SELECT version, ord, code, year, sum(n) AS n_rows, count(*) AS n_dims, count(*) FILTER (abs(s - coalesce(a, top)) <= 0.03 * coalesce(a, top)) AS ok FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY CASE WHEN ok = n_dims AND n_rows >= 2 THEN 1 ELSE 0 END DESC, ok DESC, n_rows DESC, ord) AS rn FROM p)
"""


def _routed(load):
    """The candidate that verifies best by what a run knows: anchors and agreement, never golden data; of equals the first."""
    d = load("versions").groupBy("version", "ord", "code", "year", "dim").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("s"))
    d = d.join(load("anchor").select("code", "year", F.col("revenue").cast("double").alias("a")), ["code", "year"], "left")
    target = F.coalesce("a", F.max("s").over(Window.partitionBy("version", "code", "year")))
    d = d.withColumn("ok", F.abs(F.col("s") - target) <= 0.03 * target)
    p = d.groupBy("version", "ord", "code", "year").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_dims"), F.count_if("ok").alias("ok"))
    clean = (F.col("ok") == F.col("n_dims")) & (F.col("n_rows") >= 2)
    best = p.groupBy("code", "year").agg(F.max_by(F.struct("version", clean.alias("clean"), "ok", "n_dims"), F.struct(clean.cast("int"), "ok", "n_rows", -F.col("ord"))).alias("b"))
    return best.select("code", "year", "b.*")


@query("q_route_versions", ROUTE_SQL + "SELECT code, year, version AS source, CASE WHEN ok = n_dims AND n_rows >= 2 THEN 'routed' ELSE 'needs_repair' END AS status FROM r WHERE rn = 1")
def route_versions(load):
    """The candidate that verifies best for each report: clean first, then dimensions, then rows."""
    return _routed(load).select("code", "year", F.col("version").alias("source"), F.when(F.col("clean"), "routed").otherwise("needs_repair").alias("status"))


@query("q_heal_records", ROUTE_SQL + "SELECT code, year, round(ok / n_dims, 2) AS score, CASE WHEN ok = n_dims AND n_rows >= 2 THEN 'certified' ELSE 'needs_human' END AS status FROM r WHERE rn = 1")
def heal_records(load):
    return _routed(load).select("code", "year", F.round(F.try_divide(F.col("ok"), F.col("n_dims")), 2).alias("score"), F.when(F.col("clean"), "certified").otherwise("needs_human").alias("status"))


SWEEP_SQL = """WITH s AS (SELECT version, ord, code, year, dim, sum(amount) AS s FROM versions GROUP BY ALL HAVING sum(amount) <> 0),
h AS (SELECT version, ord, code, year, bool_and(abs(CAST(s AS DOUBLE) - CAST(revenue AS DOUBLE)) <= 0.03 * CAST(revenue AS DOUBLE)) AS high FROM s JOIN anchor USING (code, year) GROUP BY ALL)
SELECT code, year, coalesce(arg_min(version, ord) FILTER (high), 'base') AS version, count(*) FILTER (high) AS n_high FROM h GROUP BY code, year"""


@query("q_rule_sweep", SWEEP_SQL)
def rule_sweep(load):
    """All rule versions at once; the first that the anchor confirms wins, the base otherwise."""
    s = load("versions").groupBy("version", "ord", "code", "year", "dim").agg(F.sum("amount").alias("s")).where("s <> 0").join(load("anchor"), ["code", "year"])
    h = s.groupBy("version", "ord", "code", "year").agg(F.bool_and(R.near(F.col("s"), F.col("revenue"), 0.03)).alias("high"))
    return h.groupBy("code", "year").agg(F.coalesce(F.min_by("version", F.when(F.col("high"), F.col("ord"))), F.lit("base")).alias("version"), F.count_if("high").alias("n_high"))
