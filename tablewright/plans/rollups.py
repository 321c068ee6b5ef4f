"""Listings, exports, coverage and quality roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.operators import reconcile as R
from tablewright.operators import rules as U
from tablewright.operators.grid import DIMENSIONS
from tablewright.plans import scores  # noqa: F401  (defines the view versions)
from tablewright.plans.base import VIEWS, query
from tablewright.plans.extras import SEM_SIG, semantic_signature
from tablewright.plans.ledgers import OUTCOME, _conf, _outcome
from tablewright.plans.revenue import CONFIDENCE_SQL, VIOLATIONS_SQL, _employees, hard_cost, hard_revenue, hard_rnd

VIEWS["pdfs"] = "SELECT code, year, concat(code, '_', CAST(year AS STRING), CASE n WHEN 0 THEN '' ELSE concat('_h', CAST(n AS STRING)) END, '.pdf') AS file FROM reports CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1) h WHERE (k + year + n) % 3 <> 0"


@query("q_list_reports", "SELECT code, year, name FROM annual WHERE quarter = 'annual' AND year >= 1996 ORDER BY year DESC, code LIMIT 50")
def list_reports(load):
    return load("annual").where("quarter = 'annual' and year >= 1996").orderBy(F.desc("year"), "code").limit(50).select("code", "year", "name")


@query("q_pending", "SELECT a.code, a.year, array_to_string(list_filter([CASE WHEN rev IS NULL THEN 'rev' END, CASE WHEN rnd_json IS NULL THEN 'rnd' END, CASE WHEN emp_json IS NULL THEN 'emp' END], lambda x: x IS NOT NULL), ',') AS missing FROM annual a WHERE quarter = 'annual' AND (rev IS NULL OR rnd_json IS NULL OR emp_json IS NULL) AND EXISTS (SELECT 1 FROM pdfs p WHERE p.code = a.code AND p.year = a.year)")
def pending(load):
    a = load("annual").where("quarter = 'annual' and (rev is null or rnd_json is null or emp_json is null)").join(load("pdfs"), ["code", "year"], "left_semi")
    miss = F.array_compact(F.array(*(F.when(F.col(c).isNull(), n) for c, n in (("rev", "rev"), ("rnd_json", "rnd"), ("emp_json", "emp")))))
    return a.select("code", "year", F.array_join(miss, ",").alias("missing"))


@query("q_needs_write", "SELECT code, year FROM annual WHERE rev IS NULL OR rev = ''")
def needs_write(load):
    return load("annual").where("rev is null or rev = ''").select("code", "year")


@query("q_status", "SELECT count(*) AS total, count(*) FILTER (rev IS NOT NULL AND rev <> '') AS parsed, count(*) FILTER (quarter = 'annual') AS annual FROM annual")
def status(load):
    return load("annual").agg(F.count("*").alias("total"), F.count_if(F.col("rev") != "").alias("parsed"), F.count_if(F.col("quarter") == "annual").alias("annual"))


#: The columns of the six fields' results.
FIELDS = {"rev": "rev", "cost": "cost_json", "rnd": "rnd_json", "emp": "emp_json", "clients": "clients_json", "suppliers": "suppliers_json"}


@query("q_export_flags", "SELECT code, year, " + ", ".join(f"CASE WHEN {c} IS NOT NULL AND {c} NOT IN ('', '{{}}', '[]') THEN 'yes' ELSE 'no' END AS has_{n}" for n, c in FIELDS.items()) + " FROM annual")
def export_flags(load):
    """yes for a field with content: empty texts, objects and lists have none."""
    return load("annual").select("code", "year", *(F.when(F.col(c).isNotNull() & ~F.col(c).isin("", "{}", "[]"), "yes").otherwise("no").alias(f"has_{n}") for n, c in FIELDS.items()))


@query("q_export_rows", "SELECT code, year, name, quarter, CAST(k AS INT) AS batch, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in FIELDS.values()) + """, count(*) OVER (PARTITION BY code) AS n_years, CAST(json_extract_string(rnd_json, '$.a') AS INT) AS rnd_a, json_array_length(nullif(cost_json, '')) AS n_costs, year = max(year) OVER (PARTITION BY code) AS latest
FROM annual WHERE quarter = 'annual' QUALIFY row_number() OVER (ORDER BY code, year DESC) <= 500""".replace("json_array_length(nullif(cost_json, ''))", "CAST(json_array_length(cost_json) AS INT)"))
def export_rows(load):
    """The export of annual rows: fifteen columns, JSON ones expanded where they are asked for, ordered, the first 500."""
    by_code = Window.partitionBy("code")
    rows = load("annual").where("quarter = 'annual'").select(
        "code", "year", "name", "quarter", F.col("k").cast("int").alias("batch"), *(F.coalesce(c, F.lit("")).alias(c) for c in FIELDS.values()), F.count("*").over(by_code).alias("n_years"),
        F.get_json_object("rnd_json", "$.a").cast("int").alias("rnd_a"), F.json_array_length("cost_json").alias("n_costs"), (F.col("year") == F.max("year").over(by_code)).alias("latest"),
    )
    return rows.orderBy("code", F.desc("year")).limit(500)


@query("q_results", "SELECT code, year, " + ", ".join(f"{c} IS NOT NULL AS has_{n}" for n, c in FIELDS.items()) + " FROM annual")
def results(load):
    """Whether each field has a value at all: here empty ones count, unlike in the export."""
    return load("annual").select("code", "year", *(F.col(c).isNotNull().alias(f"has_{n}") for n, c in FIELDS.items()))


@query("q_discover", "SELECT code, min(file) AS file FROM pdfs WHERE year = 1997 GROUP BY code")
def discover(load):
    """One file for each code and year, the first by name; the name carries both."""
    f = load("pdfs").select("file", F.split("file", "_")[0].alias("code"), F.regexp_extract("file", "_([0-9]{4})", 1).cast("int").alias("year"))
    return f.where("year = 1997").groupBy("code").agg(F.min("file").alias("file"))


@query("q_board_list", "SELECT CASE WHEN code LIKE '0000%' THEN 'main' ELSE 'other' END AS board, count(DISTINCT code) AS codes, count(DISTINCT code) FILTER (code IN (SELECT code FROM pdfs)) AS cached FROM reports GROUP BY ALL")
def board_list(load):
    cached = load("pdfs").select("code").distinct().withColumn("has", F.lit(True))
    r = load("reports").select("code").distinct().join(cached, "code", "left")
    return r.groupBy(F.when(F.col("code").startswith("0000"), "main").otherwise("other").alias("board")).agg(F.count("*").alias("codes"), F.count("has").alias("cached"))


@query("q_paged_search", "WITH m AS (SELECT code, year, name, count(*) OVER () AS total FROM annual WHERE contains(lower(code), '05') OR contains(lower(name), '银行')) SELECT * FROM m ORDER BY code, year LIMIT 20 OFFSET 10")
def paged_search(load):
    m = load("annual").where(F.lower("code").contains("05") | F.lower("name").contains("银行")).select("code", "year", "name")
    total = m.agg(F.count("*").alias("total"))  # counted on its own, so no task holds all matches
    return m.orderBy("code", "year").offset(10).limit(20).join(F.broadcast(total))


@query("q_names", "SELECT DISTINCT r.code, coalesce(s_name, r.code) AS name FROM reports r LEFT JOIN supplier ON s_suppkey = CAST(r.code AS INT) AND s_suppkey % 3 <> 0")
def names(load):
    s = load("supplier").where("s_suppkey % 3 <> 0").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), "s_name")
    return load("reports").select("code").distinct().join(s, "code", "left").select("code", F.coalesce("s_name", "code").alias("name"))


@query("q_golden_seed", CONFIDENCE_SQL + "SELECT conf.code, conf.year, CASE WHEN verdict = 'pass' THEN 'confirmed' WHEN confidence = 'low' THEN 'todo_fix' ELSE 'todo_confirm' END AS status FROM conf LEFT JOIN verdicts USING (code, year)")
def golden_seed(load):
    """Reports that a reviewer passed are confirmed already; the others are to be fixed or confirmed."""
    j = _conf(load).join(load("verdicts"), ["code", "year"], "left")
    return j.select("code", "year", F.when(F.col("verdict") == "pass", "confirmed").when(F.col("confidence") == "low", "todo_fix").otherwise("todo_confirm").alias("status"))


VIEWS["presence"] = """SELECT code, year, field, present, rule FROM (SELECT code, year, 'revenue' AS field, rev IS NOT NULL AND rev <> '' AS present, k = 3 AS rule FROM annual UNION ALL SELECT code, year, 'rnd', rnd_json IS NOT NULL, k = 2 FROM annual
    UNION ALL SELECT code, year, 'employees', emp_json IS NOT NULL, k = 4 FROM annual UNION ALL SELECT code, year, 'cost', cost_json IS NOT NULL AND cost_json <> '[]', k = 6 FROM annual
    UNION ALL SELECT code, year, 'clients', clients_json IS NOT NULL, false FROM annual UNION ALL SELECT code, year, 'suppliers', suppliers_json IS NOT NULL AND suppliers_json <> '', false FROM annual) p"""


@query("q_goldset", "SELECT code, year, field, CAST(NULL AS BOOLEAN) AS correct, present, rule AS hard_rule FROM presence")
def goldset(load):
    """A template row for each of six fields of each report: whether it has a value and breaks a hard rule, and room for a verdict."""
    a = load("annual").select(
        "code", "year", "k", (F.col("rev") != "").alias("revenue"), F.col("rnd_json").isNotNull().alias("rnd"), F.col("emp_json").isNotNull().alias("employees"),
        (F.col("cost_json") != "[]").alias("cost"), F.col("clients_json").isNotNull().alias("clients"), (F.col("suppliers_json") != "").alias("suppliers"),
    )
    u = a.unpivot(["code", "year", "k"], ["revenue", "rnd", "employees", "cost", "clients", "suppliers"], "field", "present")
    broken = F.create_map(*(F.lit(x) for kv in {"revenue": 3, "rnd": 2, "employees": 4, "cost": 6}.items() for x in kv))
    rule = F.coalesce(F.try_element_at(broken, F.col("field")) == F.col("k"), F.lit(False))
    return u.select("code", "year", "field", F.lit(None).cast("boolean").alias("correct"), F.coalesce("present", F.lit(False)).alias("present"), rule.alias("hard_rule"))


@query("q_field_coverage", "SELECT field, count(*) FILTER (present) AS n, round(100.0 * count(*) FILTER (present) / count(*), 1) AS pct FROM presence GROUP BY field")
def field_coverage(load):
    return load("presence").groupBy("field").agg(F.count_if("present").alias("n"), F.round(100.0 * F.count_if("present") / F.count("*"), 1).alias("pct"))


@query("q_field_stats", "SELECT field, count(*) FILTER (present AND NOT rule) AS ok, count(*) FILTER (present AND rule) AS error, count(*) FILTER (NOT present) AS missing, round(count(*) FILTER (present AND NOT rule) / count(*), 3) AS rate FROM presence GROUP BY field")
def field_stats(load):
    ok = F.col("present") & ~F.col("rule")
    return load("presence").groupBy("field").agg(F.count_if(ok).alias("ok"), F.count_if(F.col("present") & F.col("rule")).alias("error"), F.count_if(~F.col("present")).alias("missing"), F.round(F.count_if(ok) / F.count("*"), 3).alias("rate"))


@query("q_parse_flags", "SELECT code, year, CAST(count(*) FILTER (present) AS BIGINT) AS field_count, string_agg(field, ',' ORDER BY field) FILTER (present) AS fields FROM presence GROUP BY ALL")
def parse_flags(load):
    p = load("presence")
    return p.groupBy("code", "year").agg(F.count_if("present").alias("field_count"), F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(F.col("present"), F.col("field")))), ","), F.lit("")).alias("fields"))


def _violations(load):
    return hard_revenue(load).unionByName(hard_cost(load)).unionByName(hard_rnd(load)).unionByName(_employees(load))


@query("q_deadletter_top", VIOLATIONS_SQL + " SELECT field || ':' || rule AS key, count(*) AS n FROM v WHERE severity = 'red' GROUP BY ALL ORDER BY n DESC, key LIMIT 6")
def deadletter_top(load):
    v = _violations(load).where("severity = 'red'").groupBy(F.concat_ws(":", "field", "rule").alias("key")).agg(F.count("*").alias("n"))
    return v.orderBy(F.desc("n"), "key").limit(6)


@query("q_issue_groups", VIOLATIONS_SQL + " SELECT field, rule, severity, count(*) AS n, count(DISTINCT code) AS n_codes FROM v GROUP BY ALL")
def issue_groups(load):
    return _violations(load).groupBy("field", "rule", "severity").agg(F.count("*").alias("n"), F.count_distinct("code").alias("n_codes"))


@query("q_fix_groups", VIOLATIONS_SQL + " SELECT CASE WHEN rule = 'ratio_range' THEN 'wrong_column' WHEN field LIKE 'employees%' THEN 'missing_row' ELSE 'wrong_table' END AS cause, count(DISTINCT code) AS n_codes FROM v WHERE severity = 'red' GROUP BY ALL")
def fix_groups(load):
    cause = F.when(F.col("rule") == "ratio_range", "wrong_column").when(F.col("field").startswith("employees"), "missing_row").otherwise("wrong_table")
    return _violations(load).where("severity = 'red'").groupBy(cause.alias("cause")).agg(F.count_distinct("code").alias("n_codes"))


BASE_SQL = VIOLATIONS_SQL + """, h AS (SELECT r.code, r.year, r.k, count(*) FILTER (severity = 'red') AS red FROM reports r LEFT JOIN v USING (code, year) GROUP BY ALL)"""


def _hard(load):
    return R.hard_rules(load("reports"), hard_revenue(load), hard_cost(load), hard_rnd(load), _employees(load)).withColumn("k", F.col("code").cast("int") % 7)


@query("q_baseline", BASE_SQL + " SELECT count(*) AS n, count(*) FILTER (red = 0) AS hard_clean, count(*) FILTER (red > 0) AS hard_red, round(100.0 * count(*) FILTER (red = 0 AND k <> 5) / count(*), 1) AS net_pass_pct FROM h")
def baseline(load):
    h = _hard(load)
    return h.agg(F.count("*").alias("n"), F.count_if("passed").alias("hard_clean"), F.count_if(~F.col("passed")).alias("hard_red"), F.round(100.0 * F.count_if(F.col("passed") & (F.col("k") != 5)) / F.count("*"), 1).alias("net_pass_pct"))


@query("q_run_summary", BASE_SQL + " SELECT k AS batch, count(*) AS n, count(*) FILTER (red = 0) AS clean, CAST(sum(red) AS BIGINT) AS reds FROM h GROUP BY k")
def run_summary(load):
    return _hard(load).groupBy(F.col("k").cast("int").alias("batch")).agg(F.count("*").alias("n"), F.count_if("passed").alias("clean"), F.sum("red_count").alias("reds"))


#: The classes in which each field of a report is wrong.
WRONG = {"revenue_breakdown": (2, 3, 4, 6), "cost_breakdown": (2, 4, 6), "rnd_info": (2, 3), "employees": (3, 4)}


@query("q_confusion", BASE_SQL + """, fs AS (SELECT DISTINCT code, year, split_part(field, '.', 1) AS field FROM v WHERE severity = 'red'),
j AS (SELECT x.field, fs.field IS NOT NULL AS flagged, list_contains(x.ks, CAST(r.k AS INT)) AS wrong FROM reports r CROSS JOIN (VALUES """ + ", ".join(f"('{f}', {list(ks)})" for f, ks in WRONG.items()) + """) AS x(field, ks) LEFT JOIN fs ON fs.code = r.code AND fs.year = r.year AND fs.field = x.field),
c AS (SELECT coalesce(field, 'overall') AS field, count(*) FILTER (flagged AND wrong) AS tp, count(*) FILTER (NOT flagged AND wrong) AS fn, count(*) FILTER (flagged AND NOT wrong) AS fp, count(*) FILTER (NOT flagged AND NOT wrong) AS tn FROM j GROUP BY GROUPING SETS ((field), ()))
SELECT *, round(tp / nullif(tp + fn, 0), 4) AS recall, round(tp / nullif(tp + fp, 0), 4) AS precision, round((tp + tn) / nullif(tp + tn + fp + fn, 0), 4) AS accuracy FROM c""")
def confusion(load):
    """How well hard rules find wrong fields, overall and for each field in one pass; null where there is nothing to divide by."""
    h = _hard(load)
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.array_contains(F.split("red_fields", ","), f).alias("flagged"), F.col("k").isin(*ks).alias("wrong")) for f, ks in WRONG.items()))
    h = h.select(F.inline(each))
    f, w = F.col("flagged"), F.col("wrong")
    c = h.rollup("field").agg(F.count_if(f & w).alias("tp"), F.count_if(~f & w).alias("fn"), F.count_if(f & ~w).alias("fp"), F.count_if(~f & ~w).alias("tn"))
    rate = lambda a, b: F.round(F.try_divide(a, b), 4)
    tp, fn, fp, tn = map(F.col, ("tp", "fn", "fp", "tn"))
    return c.select(F.coalesce("field", F.lit("overall")).alias("field"), "tp", "fn", "fp", "tn", rate(tp, tp + fn).alias("recall"), rate(tp, tp + fp).alias("precision"), rate(tp + tn, tp + fn + fp + tn).alias("accuracy"))


#: What reviewers suspect, from their verdicts.
VIEWS["suspects"] = "SELECT code, year, CASE verdict WHEN 'error' THEN 'amount_error' WHEN 'wrong_table' THEN 'wrong_table' WHEN 'hold' THEN 'name_error' END AS issue FROM verdicts"
REL_SQL = CONFIDENCE_SQL + """, rl AS (SELECT conf.code, conf.year, conf.n_dims, conf.confidence, max(CAST(s AS DOUBLE) / conf.revenue) AS best, min(CAST(s AS DOUBLE)) AS lo, max(CAST(s AS DOUBLE)) AS hi FROM conf JOIN s USING (code, year) GROUP BY ALL),
rf AS (SELECT rl.*, name, n_lines, issue FROM rl JOIN annual USING (code, year) JOIN reports USING (code, year) LEFT JOIN suspects USING (code, year))"""
CLASS = "CASE WHEN n_lines <= 1 THEN '真无表' WHEN regexp_matches(name, '银行|证券|信托|保险|期货') THEN '金融域外' WHEN confidence = 'unknown' THEN '无锚' WHEN n_dims = 0 THEN '全空' WHEN best > 1.05 THEN '过计' WHEN best < 0.5 THEN '严重缺' WHEN issue = 'amount_error' THEN '取错列/单位' WHEN issue = 'name_error' THEN '抠错名称' WHEN issue = 'wrong_table' THEN '选错表' WHEN best BETWEEN 0.9 AND 1.03 AND n_dims >= 2 THEN '单维不齐' ELSE '中度缺' END"


def _rel(load):
    sums = load("pred").groupBy("code", "year", "dim").agg(F.sum("amount").cast("double").alias("s")).where("s <> 0")
    j = sums.join(R.confidence(load("pred"), load("anchor")).select("code", "year", "n_dims", "confidence", "revenue"), ["code", "year"])
    return j.groupBy("code", "year", "n_dims", "confidence").agg(F.max(F.col("s") / F.col("revenue")).alias("best"), F.min("s").alias("lo"), F.max("s").alias("hi"))


def _classed(load):
    """Reports that aren't green by what is wrong with them: eleven kinds, the first that applies."""
    best, issue = F.col("best"), F.col("issue")
    c = F.when(F.col("n_lines") <= 1, "真无表").when(T.out_of_scope(F.col("name"), F.lit("revenue_breakdown")), "金融域外").when(F.col("confidence") == "unknown", "无锚").when(F.col("n_dims") == 0, "全空").when(best > 1.05, "过计").when(best < 0.5, "严重缺")
    c = c.when(issue == "amount_error", "取错列/单位").when(issue == "name_error", "抠错名称").when(issue == "wrong_table", "选错表").when(best.between(0.9, 1.03) & (F.col("n_dims") >= 2), "单维不齐").otherwise("中度缺")
    r = _rel(load).join(load("annual").select("code", "year", "name"), ["code", "year"]).join(load("reports").select("code", "year", "n_lines"), ["code", "year"]).join(load("suspects"), ["code", "year"], "left")
    return r.where("confidence <> 'high'").withColumn("category", c)


@query("q_failure_class", REL_SQL + f" SELECT code, year, {CLASS} AS category FROM rf WHERE confidence <> 'high'")
def failure_class(load):
    return _classed(load).select("code", "year", "category")


@query("q_failure_analysis", REL_SQL + f" SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 3) AS share FROM (SELECT {CLASS} AS category FROM rf WHERE confidence <> 'high') c GROUP BY category")
def failure_analysis(load):
    n = _classed(load).groupBy("category").agg(F.count("*").alias("n"))  # categories are a fixed few
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 3))


@query("q_heal_verdict", REL_SQL + " SELECT code, year, CASE WHEN confidence = 'unknown' THEN 'no_anchor' WHEN n_dims = 0 THEN 'empty' WHEN confidence = 'high' THEN 'matched' WHEN hi / nullif(lo, 0) <= 1.03 THEN 'dims_agree' WHEN hi / nullif(lo, 0) >= 1.8 THEN 'double_count' ELSE 'contradictory' END AS verdict FROM rl")
def heal_verdict(load):
    spread = F.try_divide(F.col("hi"), F.col("lo"))
    v = F.when(F.col("confidence") == "unknown", "no_anchor").when(F.col("n_dims") == 0, "empty").when(F.col("confidence") == "high", "matched").when(spread <= 1.03, "dims_agree").when(spread >= 1.8, "double_count").otherwise("contradictory")
    return _rel(load).select("code", "year", v.alias("verdict"))


@query("q_anchor_diff", CONFIDENCE_SQL + " SELECT code, year, dim, round((CAST(s AS DOUBLE) - revenue) / revenue * 100, 2) AS pct FROM j WHERE revenue IS NOT NULL")
def anchor_diff(load):
    s = load("pred").groupBy("code", "year", "dim").agg(F.sum("amount").cast("double").alias("s")).where("s <> 0").join(load("anchor"), ["code", "year"])
    a = F.col("revenue").cast("double")
    return s.select("code", "year", "dim", F.round((F.col("s") - a) / a * 100, 2).alias("pct"))


@query("q_parse_dims", CONFIDENCE_SQL + " SELECT p.code, p.year, p.dim, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, coalesce(abs(CAST(sum(amount) AS DOUBLE) - CAST(any_value(revenue) AS DOUBLE)) <= 0.03 * CAST(any_value(revenue) AS DOUBLE), false) AS match FROM pred p LEFT JOIN anchor USING (code, year) GROUP BY ALL")
def parse_dims(load):
    d = load("pred").groupBy("code", "year", "dim").agg(F.count("*").alias("n"), F.sum("amount").alias("s")).join(load("anchor"), ["code", "year"], "left")
    return d.select("code", "year", "dim", "n", F.col("s").cast("double").alias("total"), R.near(F.col("s"), F.col("revenue"), 0.03).alias("match"))


@query("q_missing_dims", "SELECT * FROM (SELECT r.code, r.year, d.dim FROM reports r CROSS JOIN (SELECT unnest(['industries', 'segments', 'regions', 'by_channel']) AS dim) d EXCEPT SELECT code, year, dim FROM pred WHERE NOT (k = 3 AND dim = 'segments')) x")
def missing_dims(load):
    want = load("reports").select("code", "year", F.explode(F.array(*map(F.lit, ("industries", "segments", "regions", "by_channel")))).alias("dim"))
    return want.subtract(load("pred").where("not (k = 3 and dim = 'segments')").select("code", "year", "dim"))


@query("q_steward_buckets", REL_SQL + f" SELECT CASE WHEN c IN ('过计', '单维不齐') THEN 'parse' WHEN c IN ('严重缺', '全空', '选错表', '真无表') THEN 'selection' WHEN c IN ('中度缺', '取错列/单位', '抠错名称') THEN 'extraction' ELSE 'data' END AS layer, count(*) AS n FROM (SELECT {CLASS} AS c FROM rf WHERE confidence <> 'high') x GROUP BY ALL")
def steward_buckets(load):
    c = F.col("category")
    layer = F.when(c.isin("过计", "单维不齐"), "parse").when(c.isin("严重缺", "全空", "选错表", "真无表"), "selection").when(c.isin("中度缺", "取错列/单位", "抠错名称"), "extraction").otherwise("data")
    return _classed(load).groupBy(layer.alias("layer")).agg(F.count("*").alias("n"))


@query("q_low_outcomes", CONFIDENCE_SQL + f" SELECT conf.code, conf.year, {OUTCOME} AS outcome, n_dims, dims_hit FROM conf JOIN annual USING (code, year) WHERE confidence = 'low'")
def low_outcomes(load):
    return _outcome(load).where("confidence = 'low'").select("code", "year", "outcome", "n_dims", "dims_hit")


@query("q_field_chain")
def field_chain(load):
    """The stages a report went through, as an array of (name, ok)."""
    o = _outcome(load)
    stage = lambda name, ok: F.struct(F.lit(name).alias("name"), ok.alias("ok"))
    return o.select("code", "year", F.array(stage("parse", F.col("n_dims") > 0), stage("anchor", F.col("confidence") != "unknown"), stage("match", F.col("confidence") == "high")).alias("chain"))


@query("q_decide", CONFIDENCE_SQL + " SELECT code, year, CASE WHEN confidence = 'high' THEN 'archive' WHEN confidence = 'low' AND year % 4 < 3 THEN 'optimize' ELSE 'human' END AS step FROM conf")
def decide(load):
    return _conf(load).select("code", "year", F.when(F.col("confidence") == "high", "archive").when((F.col("confidence") == "low") & (F.col("year") % 4 < 3), "optimize").otherwise("human").alias("step"))


@query("q_exclude_candidates", "WITH t AS (SELECT code, year, dim FROM shared GROUP BY ALL HAVING sum(ratio) > 102), r AS (SELECT code, year, dim, name, ratio, CAST(row_number() OVER (PARTITION BY code, year, dim ORDER BY ratio DESC, name) AS INT) AS rn FROM shared JOIN t USING (code, year, dim) WHERE ratio IS NOT NULL) SELECT * FROM r WHERE rn <= 3")
def exclude_candidates(load):
    """The three largest rows of dimensions whose shares sum to more than 102."""
    w = Window.partitionBy("code", "year", "dim")
    s = load("shared").withColumn("t", F.sum("ratio").over(w)).where("t > 102 and ratio is not null")
    return s.withColumn("rn", F.row_number().over(w.orderBy(F.desc("ratio"), "name"))).where("rn <= 3").select("code", "year", "dim", "name", "ratio", "rn")


@query("q_registry_route", BASE_SQL + " SELECT year, arg_max(code, (red = 0, -red, code)) AS code FROM h GROUP BY year")
def registry_route(load):
    """The best result of each year: passed first, fewest reds, then the largest code."""
    return _hard(load).groupBy("year").agg(F.max_by("code", F.struct("passed", -F.col("red_count"), "code")).alias("code"))


@query("q_root_cause", BASE_SQL + " SELECT year, round(count(*) FILTER (red = 0) / count(*), 4) AS passed_ratio, CASE WHEN count(*) FILTER (red = 0) / count(*) < 0.5 THEN 'global' ELSE 'local' END AS severity FROM h GROUP BY year")
def root_cause(load):
    r = _hard(load).groupBy("year").agg(F.round(F.count_if("passed") / F.count("*"), 4).alias("passed_ratio"), (F.count_if("passed") / F.count("*")).alias("r"))
    return r.select("year", "passed_ratio", F.when(F.col("r") < 0.5, "global").otherwise("local").alias("severity"))


@query("q_smoke", "SELECT version, bool_or(n > 0) AS runs, CAST(min(n) AS BIGINT) AS least_rows FROM (SELECT version, code, year, count(*) AS n FROM versions GROUP BY ALL) x GROUP BY version")
def smoke(load):
    n = load("versions").groupBy("version", "code", "year").agg(F.count("*").alias("n"))
    return n.groupBy("version").agg(F.bool_or(F.col("n") > 0).alias("runs"), F.min("n").alias("least_rows"))


VIEWS["dbrows"] = "SELECT code, year, CASE n WHEN 0 THEN 'annual' ELSE 'q3' END AS quarter, year * 10 + n AS stamp, CASE WHEN n = 0 AND k = 2 THEN -1.0 WHEN n = 0 AND k = 3 THEN NULL ELSE CAST(revenue AS DOUBLE) + n END AS revenue FROM anchor JOIN reports USING (code, year) CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) q"


@query("q_anchor_db", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY quarter = 'annual' DESC, stamp DESC) AS rn FROM dbrows) SELECT code, year, CASE WHEN revenue > 0 THEN revenue END AS revenue FROM r WHERE rn = 1")
def anchor_db(load):
    """Annual rows before others, then the latest; only positive numbers are anchors."""
    d = load("dbrows").groupBy("code", "year").agg(F.max_by("revenue", F.struct(F.col("quarter") == "annual", "stamp")).alias("revenue"))
    return d.select("code", "year", F.when(F.col("revenue") > 0, F.col("revenue")).alias("revenue"))


@query("q_anchor_merge", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY quarter = 'annual' DESC, stamp DESC) AS rn FROM dbrows) SELECT r.code, r.year, coalesce(CASE WHEN r.revenue > 0 THEN r.revenue END, CAST(a.revenue AS DOUBLE)) AS revenue, r.revenue > 0 IS NOT TRUE AS filled FROM r JOIN anchor a USING (code, year) WHERE rn = 1")
def anchor_merge(load):
    """Gaps in the database's anchors filled from the report's own tables."""
    db = anchor_db(load).withColumnRenamed("revenue", "db")
    return db.join(load("anchor"), ["code", "year"]).select("code", "year", F.coalesce("db", F.col("revenue").cast("double")).alias("revenue"), F.col("db").isNull().alias("filled"))


@query("q_main_business", """WITH p AS (SELECT code, year, CAST(revenue AS DOUBLE) AS r, CAST(main_revenue AS DOUBLE) / CASE WHEN year % 2 = 0 THEN 1e4 ELSE 1 END AS m, CAST(revenue - main_revenue AS DOUBLE) / CASE WHEN year % 2 = 0 THEN 1e4 ELSE 1 END AS o FROM anchor),
u AS (SELECT p.*, u FROM p CROSS JOIN (SELECT unnest([1.0::DOUBLE, 1e3, 1e4, 1e8]) AS u) x WHERE abs((m + o) * u - r) <= 0.03 * r) SELECT code, year, round(arg_min(m * u, u), 2) AS main_revenue FROM u GROUP BY code, year HAVING arg_min(m * u, u) < any_value(r)""")
def main_business(load):
    """Main business income from a table in some unit: the first unit in which main and other make the revenue."""
    f = F.when(F.col("year") % 2 == 0, 1e4).otherwise(1.0)
    p = load("anchor").select("code", "year", F.col("revenue").cast("double").alias("r"), (F.col("main_revenue").cast("double") / f).alias("m"), ((F.col("revenue") - F.col("main_revenue")).cast("double") / f).alias("o"))
    u = p.withColumn("u", F.explode(F.array(*map(F.lit, (1.0, 1e3, 1e4, 1e8))))).where(F.abs((F.col("m") + F.col("o")) * F.col("u") - F.col("r")) <= 0.03 * F.col("r"))
    first = u.groupBy("code", "year").agg(F.min_by(F.col("m") * F.col("u"), "u").alias("main"), F.first("r").alias("r")).where("main < r")
    return first.select("code", "year", F.round("main", 2).alias("main_revenue"))


@query("q_rnd_selfcheck", "SELECT code, year, abs(CAST(sum(amount) AS DOUBLE) - CAST(any_value(total) AS DOUBLE)) <= greatest(1.0, 1e-4 * CAST(any_value(total) AS DOUBLE)) AS ok FROM rnd JOIN rnd_total USING (code, year) GROUP BY ALL")
def rnd_selfcheck(load):
    r = load("rnd").groupBy("code", "year").agg(F.sum("amount").cast("double").alias("s")).join(load("rnd_total"), ["code", "year"])
    t = F.col("total").cast("double")
    return r.select("code", "year", (F.abs(F.col("s") - t) <= F.greatest(F.lit(1.0), 1e-4 * t)).alias("ok"))


@query("q_validator_logic", "SELECT code, year, dim, round(sum(ratio), 2) AS s, round(sum(ratio), 2) BETWEEN 95 AND 105 AS ok FROM shared WHERE dim <> 'by_channel' AND ratio IS NOT NULL GROUP BY ALL")
def validator_logic(load):
    s = load("shared").where("dim <> 'by_channel' and ratio is not null").groupBy("code", "year", "dim").agg(F.sum("ratio").alias("t"))
    return s.select("code", "year", "dim", F.round("t", 2).alias("s"), F.round("t", 2).between(95, 105).alias("ok"))


@query("q_validator_complete", "SELECT code, year, count(*) FILTER (present) AS n_present, count(*) FILTER (present) = 6 AS complete FROM presence GROUP BY ALL")
def validator_complete(load):
    return load("presence").groupBy("code", "year").agg(F.count_if("present").alias("n_present"), (F.count_if("present") == 6).alias("complete"))


@query("q_validator_score", """WITH c AS (SELECT code, year, round(sum(ratio), 2) BETWEEN 95 AND 105 AS ok FROM shared WHERE ratio IS NOT NULL GROUP BY code, year, dim UNION ALL SELECT code, year, present FROM presence)
SELECT code, year, round(count(*) FILTER (ok) / count(*), 4) AS score, CASE WHEN count(*) FILTER (ok) = count(*) THEN 'pass' WHEN count(*) FILTER (ok) / count(*) < 0.6 THEN 'new' ELSE 'modify' END AS suggest FROM c GROUP BY code, year""")
def validator_score(load):
    s = load("shared").where("ratio is not null").groupBy("code", "year", "dim").agg(F.round(F.sum("ratio"), 2).between(95, 105).alias("ok")).select("code", "year", "ok")
    c = s.unionByName(load("presence").select("code", "year", F.col("present").alias("ok"))).groupBy("code", "year").agg((F.count_if("ok") / F.count("*")).alias("s"))
    return c.select("code", "year", F.round("s", 4).alias("score"), F.when(F.col("s") == 1, "pass").when(F.col("s") < 0.6, "new").otherwise("modify").alias("suggest"))


@query("q_status_checks", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN round(sum(ratio), 2) > 100.5 THEN 'over' WHEN round(sum(ratio), 2) BETWEEN 80 AND 120 THEN 'ok' ELSE 'short' END AS status FROM shared WHERE ratio IS NOT NULL GROUP BY code, year, dim) x GROUP BY status")
def status_checks(load):
    t = F.col("t")
    s = load("shared").where("ratio is not null").groupBy("code", "year", "dim").agg(F.round(F.sum("ratio"), 2).alias("t"))
    return s.groupBy(F.when(t > 100.5, "over").when(t.between(80, 120), "ok").otherwise("short").alias("status")).agg(F.count("*").alias("n"))


#: A pool of rule versions: aliases of roles with their place; version 0 is the base.
VIEWS["rule_pool"] = "SELECT CAST(p_partkey % 4 AS INT) AS version, p_type AS role, p_brand AS alias, CAST(p_size AS INT) AS pos FROM part"
#: Requested changes, of which some are of unknown roles, too short, known already or against what is known.
VIEWS["alias_requests"] = "SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 'margin' ELSE p_type END AS role, CASE WHEN p_size % 7 = 0 THEN 'x' WHEN p_size % 3 = 0 THEN p_brand ELSE concat(p_brand, '甲') END AS alias FROM part"
VIEWS["marker_requests"] = """SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '分行业' WHEN 1 THEN concat('按', p_brand, '分') WHEN 2 THEN ' 分地区 ' ELSE 'x' END AS marker, CASE p_size % 5 WHEN 0 THEN 'industries' WHEN 1 THEN 'regions' WHEN 2 THEN 'colours' ELSE 'segments' END AS dim FROM part"""
_MARKERS = ", ".join(f"('{m}', '{d}')" for m, d in DIMENSIONS.items())


@query("q_rule_merge", """WITH v AS (SELECT DISTINCT version FROM rule_pool), u AS (SELECT v.version, role, alias, p.version > 0 AS added, pos FROM v JOIN rule_pool p ON p.version = 0 OR p.version = v.version), f AS (SELECT version, role, alias, min((added, pos)) AS first_at FROM u GROUP BY ALL)
SELECT version, role, alias, CAST(row_number() OVER (PARTITION BY version, role ORDER BY first_at, alias) AS INT) AS place FROM f""")
def rule_merge(load):
    """Every version's rule: the base's aliases in their order, then what the version adds."""
    return U.merged(load("rule_pool"))


@query("q_rule_override", "SELECT role, count(DISTINCT alias) AS n FROM rule_pool WHERE version IN (0, 2) GROUP BY role")
def rule_override(load):
    """The rule of one version in place of the current one: a filter, with no state to put back."""
    return U.at_version(load("rule_pool"), 2).groupBy("role").agg(F.count("*").alias("n"))


@query("q_sanitize_delta", "SELECT id, r.role, trim(r.alias) AS alias FROM alias_requests r WHERE length(trim(alias)) BETWEEN 2 AND 12 AND EXISTS (SELECT 1 FROM rule_pool p WHERE p.version = 0 AND p.role = r.role) AND NOT EXISTS (SELECT 1 FROM rule_pool p WHERE p.version = 0 AND p.role = r.role AND p.alias = trim(r.alias))")
def sanitize_delta(load):
    """Only aliases of known roles, of a fair length and not known yet, may change a rule."""
    return U.sanitized(load("alias_requests"), U.at_version(load("rule_pool"), 0))


@query("q_add_marker", f"""SELECT id, CASE WHEN length(trim(r.marker)) < 2 OR r.dim NOT IN ('industries', 'segments', 'regions', 'by_channel') THEN 'invalid' WHEN m.dim = r.dim THEN 'noop' WHEN m.dim IS NOT NULL THEN 'conflict' ELSE 'added' END AS outcome
FROM marker_requests r LEFT JOIN (VALUES {_MARKERS}) AS m(marker, dim) ON m.marker = trim(r.marker)""")
def add_marker(load):
    """New section markers against those of the rules: invalid, known with the same dimension, known with another, or added."""
    return U.add_markers(load("marker_requests"), DIMENSIONS)


@query("q_profile_priority", "WITH p AS (SELECT code, year, page, 'report' AS level, 0 AS prio, table_id FROM placed WHERE cols = 2 UNION ALL SELECT code, year, page, 'fingerprint', 1, table_id FROM placed WHERE cols = 3), r AS (SELECT *, row_number() OVER (PARTITION BY code, year, page ORDER BY prio, table_id) AS rn FROM p WHERE year % 3 <> 0) SELECT code, year, page, level, table_id FROM r WHERE rn = 1")
def profile_priority(load):
    """Which extraction profile a page gets: the report's own before its fingerprint's; reports in sync need none."""
    p = load("placed").where("year % 3 <> 0").withColumn("prio", F.when(F.col("cols") == 2, 0).otherwise(1))
    b = p.groupBy("code", "year", "page").agg(F.min(F.struct("prio", "table_id")).alias("b"))
    return b.select("code", "year", "page", F.when(F.col("b.prio") == 0, "report").otherwise("fingerprint").alias("level"), "b.table_id")


@query("q_mismatch_checks", "SELECT code, year, count(*) FILTER (contains(text, '财务')) AS n_sheet, CASE WHEN count(*) FILTER (contains(text, '财务')) >= 3 THEN 'balance_sheet' WHEN count(*) > 90 THEN 'too_many' ELSE 'fine' END AS verdict FROM report_page GROUP BY ALL")
def mismatch_checks(load):
    n = load("report_page").groupBy("code", "year").agg(F.count_if(F.col("text").contains("财务")).alias("n_sheet"), F.count("*").alias("n"))
    return n.select("code", "year", "n_sheet", F.when(F.col("n_sheet") >= 3, "balance_sheet").when(F.col("n") > 90, "too_many").otherwise("fine").alias("verdict"))


@query("q_header_clusters", SEM_SIG + " SELECT sig, count(*) AS n, count(DISTINCT code) AS n_codes FROM sg GROUP BY sig")
def header_clusters(load):
    """Tables by the roles of their columns in order."""
    return semantic_signature(load).groupBy("sig").agg(F.count("*").alias("n"), F.count_distinct("code").alias("n_codes"))
