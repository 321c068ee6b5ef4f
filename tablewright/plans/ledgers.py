"""Event logs, latest states and routing of records, over the events and conversations tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.operators import ledger as L
from tablewright.operators import reconcile as R
from tablewright.plans.base import VIEWS, query
from tablewright.plans.revenue import CONFIDENCE_SQL

VIEWS["triage"] = """
    SELECT event_id AS seq, ts, CAST(user_id % 50 AS INT) AS code, CASE WHEN event_id % 3 = 0 THEN 'revenue' WHEN event_id % 3 = 1 THEN 'cost' ELSE 'rnd' END AS field, event_type AS reason,
      CASE WHEN event_id % 5 = 0 THEN 'resolved' WHEN event_id % 7 = 0 THEN 'ok' ELSE 'open' END AS status FROM events"""
VIEWS["runs"] = """
    SELECT event_id AS id, CAST(user_id % 40 AS INT) AS code, CASE WHEN event_id % 2 = 0 THEN 'revenue' ELSE 'cost' END AS field, CAST(floor(event_id / 25) AS INT) AS run_id, event_type AS outcome, event_type = 'error' AS red, CAST(event_id % 97 AS INT) AS item,
      CASE WHEN event_id % 11 = 0 THEN concat('v', CAST(event_id % 3 AS STRING)) END AS verdict, value FROM events"""

#: What is stored of each report, and who it is.
VIEWS["annual"] = """
    SELECT code, year, k, CASE WHEN k <> 5 THEN 'annual' ELSE 'q3' END AS quarter, CASE WHEN k = 1 THEN NULL WHEN k = 2 THEN '' ELSE '{}' END AS rev, CASE WHEN k = 3 THEN NULL ELSE '{"a":1}' END AS rnd_json,
      CASE WHEN year % 3 = 0 THEN NULL ELSE '[1]' END AS emp_json,
      CASE WHEN k = 4 THEN NULL WHEN year % 2 = 0 THEN '[]' ELSE '[{"n":1}]' END AS cost_json, CASE WHEN k IN (1, 6) THEN NULL ELSE '{"items":[]}' END AS clients_json, CASE WHEN k = 6 THEN '' WHEN year % 5 = 0 THEN NULL ELSE '{"items":[1]}' END AS suppliers_json, concat('公司', code, CASE WHEN k = 6 AND year % 2 = 0 THEN '银行' ELSE '' END) AS name FROM reports"""
VIEWS["verdicts"] = "SELECT code, year, CASE (CAST(code AS INT) + year) % 5 WHEN 0 THEN 'hold' WHEN 1 THEN 'pass' WHEN 2 THEN 'error' WHEN 3 THEN 'wrong_table' END AS verdict FROM reports WHERE year % 3 <> 0"
#: The lines of a progress file; some are cut off.
VIEWS["progress_lines"] = """
    SELECT CASE WHEN k = 1 AND year % 2 = 0 THEN concat('{"code":"', code) ELSE concat('{"code":"', code, '","year":', CAST(year AS STRING), ',"status":"', CASE WHEN k = 2 THEN 'error' ELSE 'ok' END, '"}') END AS line FROM reports WHERE k < 5"""


@query("q_triage_state", "SELECT code, field, arg_max(reason, seq) AS reason, arg_max(status, seq) AS status, min(ts) AS created_at, max(ts) AS updated_at, count(*) AS n_events FROM triage GROUP BY ALL")
def triage_state(load):
    return L.triage_state(load("triage"), ("code", "field"))


STATE = "st AS (SELECT code, field, arg_max(reason, seq) AS reason, arg_max(status, seq) AS status FROM triage GROUP BY ALL)"


@query("q_triage_summary", f"""WITH {STATE} SELECT 'status' AS kind, status AS key, count(*) AS n FROM st GROUP BY status UNION ALL SELECT 'open_reason', reason, count(*) FROM st WHERE status = 'open' GROUP BY reason
UNION ALL SELECT 'ok_field', field, count(*) FROM st WHERE status IN ('ok', 'resolved') GROUP BY field UNION ALL SELECT 'verified_permille', 'all', CAST(round(1000 * count(*) FILTER (status IN ('ok', 'resolved')) / count(*)) AS BIGINT) FROM st""")
def triage_summary(load):
    """Four roll-ups of the same state, which is aggregated once and reused."""
    s = L.triage_state(load("triage"), ("code", "field"))
    good = F.col("status").isin("ok", "resolved")
    part = lambda df, kind, key: df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "key", "n")
    rate = s.agg(F.round(1000 * F.count_if(good) / F.count("*")).cast("bigint").alias("n")).select(F.lit("verified_permille").alias("kind"), F.lit("all").alias("key"), "n")
    return part(s, "status", "status").unionByName(part(s.where("status = 'open'"), "open_reason", "reason")).unionByName(part(s.where(good), "ok_field", "field")).unionByName(rate)


@query("q_latest_runs", "SELECT code, field, max(id) AS id, arg_max(run_id, id) AS run_id, arg_max(outcome, id) AS outcome FROM runs GROUP BY ALL")
def latest_runs(load):
    return L.latest(load("runs"), ("code", "field"), "id", ("id", "run_id", "outcome"))


@query("q_upsert_keep", "SELECT code, field, arg_max(outcome, id) AS auto, arg_max(verdict, id) FILTER (verdict IS NOT NULL) AS verdict FROM runs GROUP BY ALL")
def upsert_keep(load):
    return L.upsert_keep(load("runs").select("code", "field", F.col("id").alias("seq"), F.col("outcome").alias("auto"), "verdict"), ("code", "field"))


@query("q_timeline", """WITH l AS (SELECT code, field, arg_max(run_id, id) AS run_id FROM runs GROUP BY ALL), t AS (SELECT r.*, CAST(row_number() OVER (PARTITION BY code, field ORDER BY id) AS INT) AS n FROM runs r JOIN l USING (code, field, run_id))
SELECT code, field, run_id, id, outcome, n FROM t WHERE n <= 20""")
def timeline(load):
    return L.timeline(load("runs"), ("code", "field")).select("code", "field", "run_id", "id", "outcome", "n")


@query("q_commit_queue", "SELECT code, field, arg_max(outcome, id) AS outcome, CASE arg_max(id % 4, id) WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status FROM runs WHERE field = 'revenue' GROUP BY ALL")
def commit_queue(load):
    """Latest entry of whitelisted fields; an entry is pending until a decision follows."""
    r = load("runs").where("field = 'revenue'").withColumn("status", F.when(F.col("id") % 4 == 0, "approved").when(F.col("id") % 4 == 1, "rejected").otherwise("pending"))
    return L.latest(r, ("code", "field"), "id", ("outcome", "status"))


@query("q_commit_overlay", "SELECT b.code, b.year, coalesce(p.amount, b.amount) AS amount FROM (SELECT code, year, CAST(sum(amount) AS DOUBLE) AS amount FROM pred GROUP BY ALL) b LEFT JOIN (SELECT code, year, CAST(revenue AS DOUBLE) AS amount FROM anchor WHERE year % 2 = 0) p USING (code, year)")
def commit_overlay(load):
    base = load("pred").groupBy("code", "year").agg(F.sum("amount").cast("double").alias("amount"))
    patch = load("anchor").where("year % 2 = 0").select("code", "year", F.col("revenue").cast("double").alias("amount"))
    return L.overlay(base, patch, ("code", "year"), "amount")


@query("q_canonical", """WITH c AS (SELECT code, year, dim, name, CAST(amount AS DOUBLE) AS amount, 'routed' AS source, 0 AS p FROM golden WHERE k IN (0, 2) UNION ALL SELECT code, year, dim, name, CAST(amount AS DOUBLE), 'cold', 1 FROM pred),
r AS (SELECT *, row_number() OVER (PARTITION BY code, year, dim, name ORDER BY p) AS rn FROM c) SELECT code, year, dim, name, amount, source FROM r WHERE rn = 1""")
def canonical(load):
    """One value for each item: routed before cold start."""
    value = F.col("amount").cast("double").alias("amount")
    routed = load("golden").where("k in (0, 2)").select("code", "year", "dim", "name", value, F.lit("routed").alias("source"), F.lit(0).alias("p"))
    cold = load("pred").select("code", "year", "dim", "name", value, F.lit("cold").alias("source"), F.lit(1).alias("p"))
    return L.by_priority(routed.unionByName(cold), ("code", "year", "dim", "name"), F.col("p"), ("amount", "source"))


def _conf(load):
    return R.confidence(load("pred"), load("anchor")).select("code", "year", "confidence", "n_dims", "dims_hit").withColumn("k", F.col("code").cast("int") % 7)


@query("q_triage_route", CONFIDENCE_SQL + "SELECT conf.code, conf.year, CASE WHEN coalesce(rev, '') = '' THEN 'needs_write' WHEN confidence = 'high' THEN 'verify' WHEN confidence = 'low' THEN 'low_confidence' ELSE 'unverified' END AS route FROM conf JOIN annual USING (code, year)")
def triage_route(load):
    """Reports without a stored value are written first; the others go by their confidence."""
    j = _conf(load).join(load("annual").select("code", "year", "rev"), ["code", "year"])
    return j.select("code", "year", F.when(F.coalesce("rev", F.lit("")) == "", "needs_write").when(F.col("confidence") == "high", "verify").when(F.col("confidence") == "low", "low_confidence").otherwise("unverified").alias("route"))


@query("q_verify_route", CONFIDENCE_SQL + "SELECT conf.code, conf.year, CASE WHEN verdict = 'hold' THEN 'review_hold' WHEN verdict = 'pass' THEN 'commit' ELSE 'ok' END AS route FROM conf LEFT JOIN verdicts USING (code, year) WHERE confidence = 'high'")
def verify_route(load):
    j = _conf(load).where("confidence = 'high'").join(load("verdicts"), ["code", "year"], "left")
    return j.select("code", "year", F.when(F.col("verdict") == "hold", "review_hold").when(F.col("verdict") == "pass", "commit").otherwise("ok").alias("route"))


@query("q_chat_route", "SELECT code, year, CASE WHEN verdict IN ('wrong_table', 'incomplete_table', 'hold') THEN 'needs_human' WHEN verdict = 'pass' THEN 'commit' ELSE 'all_ok' END AS route FROM verdicts")
def chat_route(load):
    return load("verdicts").select("code", "year", F.when(F.col("verdict").isin("wrong_table", "incomplete_table", "hold"), "needs_human").when(F.col("verdict") == "pass", "commit").otherwise("all_ok").alias("route"))


@query("q_review_queue", f"""WITH {STATE}, lv AS (SELECT code, field, arg_max(verdict, id) AS verdict FROM runs WHERE verdict IS NOT NULL GROUP BY ALL), o AS (SELECT code, field FROM st WHERE status = 'open' AND reason = (SELECT min(reason) FROM st) ORDER BY code, field LIMIT 20)
SELECT code, field, CASE WHEN verdict = 'v0' THEN 'requeued' WHEN verdict = 'v1' THEN 'resolved' ELSE 'kept' END AS outcome FROM o LEFT JOIN lv USING (code, field)""")
def review_queue(load):
    """The first 20 open items of one reason, with what their latest verdict makes of them."""
    s = L.triage_state(load("triage"), ("code", "field"))
    verdicts = L.latest(load("runs").where("verdict is not null"), ("code", "field"), "id", ("verdict",))
    q = s.where("status = 'open'").join(F.broadcast(s.agg(F.min("reason").alias("reason"))), "reason", "left_semi").orderBy("code", "field").limit(20)
    return q.join(verdicts, ["code", "field"], "left").select("code", "field", F.when(F.col("verdict") == "v0", "requeued").when(F.col("verdict") == "v1", "resolved").otherwise("kept").alias("outcome"))


OUTCOME = "CASE WHEN regexp_matches(name, '银行|证券|信托|保险|期货') THEN 'out_of_scope' WHEN n_dims < 4 THEN 'no_data' WHEN confidence = 'unknown' THEN 'no_anchor' WHEN confidence = 'high' THEN 'green' ELSE 'non_green' END"


def _outcome(load):
    c = _conf(load).join(load("annual").select("code", "year", "name"), ["code", "year"])
    o = F.when(T.out_of_scope(F.col("name"), F.lit("revenue_breakdown")), "out_of_scope").when(F.col("n_dims") < 4, "no_data").when(F.col("confidence") == "unknown", "no_anchor").when(F.col("confidence") == "high", "green").otherwise("non_green")
    return c.withColumn("outcome", o)


@query("q_outcome", CONFIDENCE_SQL + f"SELECT code, year, {OUTCOME} AS outcome FROM conf JOIN annual USING (code, year)")
def outcome(load):
    return _outcome(load).select("code", "year", "outcome")


RESCUE = """rs AS (SELECT code, year, min(u) AS unit FROM (SELECT code, year, u FROM j CROSS JOIN (SELECT unnest([1e3, 1e4, 1e8]::DOUBLE[]) AS u) x WHERE revenue IS NOT NULL GROUP BY code, year, u HAVING bool_and(abs(CAST(s AS DOUBLE) * u - revenue) <= 0.03 * revenue)) y GROUP BY ALL)"""


@query("q_unit_rescue", CONFIDENCE_SQL + f", {RESCUE} SELECT * FROM rs")
def unit_rescue(load):
    """The least factor by which all dimensions of a report meet the anchor."""
    return R.unit_rescue(load("pred"), load("anchor"))


@query("q_heal_cascade", CONFIDENCE_SQL + f""", {RESCUE}, o AS (SELECT code, year, {OUTCOME} AS outcome FROM conf JOIN annual USING (code, year))
SELECT code, year, CASE WHEN outcome = 'green' AND verdict = 'pass' THEN 'committed' WHEN outcome = 'green' AND verdict = 'hold' THEN 'verify_hold' WHEN outcome = 'non_green' AND unit IS NOT NULL THEN 'rescued_unit'
  WHEN outcome = 'non_green' AND verdict = 'wrong_table' THEN 'no_such_table' WHEN outcome = 'non_green' THEN 'codegen_still_bad' ELSE outcome END AS outcome FROM o LEFT JOIN verdicts USING (code, year) LEFT JOIN rs USING (code, year)""")
def heal_cascade(load):
    """Outcomes after repair: the first step of the cascade that applies decides. A unit slip is one that a factor mends."""
    j = _outcome(load).join(load("verdicts"), ["code", "year"], "left").join(R.unit_rescue(load("pred"), load("anchor")), ["code", "year"], "left")
    o, v = F.col("outcome"), F.col("verdict")
    return j.select("code", "year", F.when((o == "green") & (v == "pass"), "committed").when((o == "green") & (v == "hold"), "verify_hold").when((o == "non_green") & F.col("unit").isNotNull(), "rescued_unit").when((o == "non_green") & (v == "wrong_table"), "no_such_table").when(o == "non_green", "codegen_still_bad").otherwise(o).alias("outcome"))


@query("q_pending_gate", CONFIDENCE_SQL + "SELECT code, year, confidence = 'high' AS written, CASE WHEN confidence = 'high' THEN 'verify' WHEN confidence = 'low' THEN 'review' ELSE 'none' END AS pending FROM conf")
def pending_gate(load):
    return _conf(load).select("code", "year", (F.col("confidence") == "high").alias("written"), F.when(F.col("confidence") == "high", "verify").when(F.col("confidence") == "low", "review").otherwise("none").alias("pending"))


@query("q_assemble", """SELECT code, year, (SELECT count(*) FROM pred p WHERE p.code = r.code AND p.year = r.year) AS n_revenue, (SELECT count(*) FROM costs c WHERE c.code = r.code AND c.year = r.year) AS n_cost,
  (SELECT count(*) FROM rnd d WHERE d.code = r.code AND d.year = r.year) AS n_rnd, (SELECT count(*) FROM emp e WHERE e.code = r.code AND e.year = r.year) AS n_employees FROM reports r""")
def assemble(load):
    """One row for each report with the rows of each field: counts by field, in one shuffle of (report, field)."""
    parts = [load(v).select("code", "year", F.lit(f).alias("field")) for v, f in (("pred", "n_revenue"), ("costs", "n_cost"), ("rnd", "n_rnd"), ("emp", "n_employees"))]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    n = u.groupBy("code", "year").agg(*(F.count_if(F.col("field") == f).alias(f) for f in ("n_revenue", "n_cost", "n_rnd", "n_employees")))
    return load("reports").select("code", "year").join(n, ["code", "year"], "left").na.fill(0)


_DONE = "pl AS (SELECT CASE WHEN json_valid(line) THEN json_extract_string(line, '$.code') END AS code, CASE WHEN json_valid(line) THEN CAST(json_extract_string(line, '$.year') AS INT) END AS year, CASE WHEN json_valid(line) THEN json_extract_string(line, '$.status') END AS status, line FROM progress_lines)"


@query("q_resume", f"WITH {_DONE} SELECT code, year FROM reports r WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.code = r.code AND pl.year = r.year AND status = 'ok')")
def resume(load):
    """What is left to do: all reports but those that a readable line says are done."""
    done, _ = L.read_lines(load("progress_lines"), "code string, year int, status string")
    return load("reports").select("code", "year").join(done.where("status = 'ok'"), ["code", "year"], "left_anti")


@query("q_dead_letters", f"WITH {_DONE} SELECT CASE WHEN code IS NULL THEN 'malformed' ELSE status END AS reason, count(*) AS n FROM pl WHERE code IS NULL OR status <> 'ok' GROUP BY ALL")
def dead_letters(load):
    """Lines that can't be read, and those that report an error."""
    good, dead = L.read_lines(load("progress_lines"), "code string, year int, status string")
    return good.where("status <> 'ok'").select(F.col("status").alias("reason")).unionByName(dead.select(F.lit("malformed").alias("reason"))).groupBy("reason").agg(F.count("*").alias("n"))


@query("q_batch_progress", "SELECT outcome, count(*) AS n, CAST(max(id) AS BIGINT) AS last_id FROM runs GROUP BY ALL")
def batch_progress(load):
    return load("runs").groupBy("outcome").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


@query("q_stage_stats", "SELECT field AS stage, coalesce(verdict, 'none') AS verdict, count(*) AS n FROM runs GROUP BY ALL")
def stage_stats(load):
    return load("runs").groupBy(F.col("field").alias("stage"), F.coalesce("verdict", F.lit("none")).alias("verdict")).agg(F.count("*").alias("n"))


@query("q_experience", """WITH h AS (SELECT code, field, outcome, count(*) AS hits FROM runs GROUP BY ALL), e AS (SELECT *, row_number() OVER (PARTITION BY code, field ORDER BY hits DESC, outcome) AS rn FROM h)
SELECT code, field, outcome, hits FROM e WHERE rn = 1""")
def experience(load):
    h = load("runs").groupBy("code", "field", "outcome").agg(F.count("*").alias("hits"))
    w = Window.partitionBy("code", "field").orderBy(F.desc("hits"), "outcome")
    return h.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


@query("q_certify", "SELECT CAST(code AS INT) AS code, field, string_agg(DISTINCT outcome, ',' ORDER BY outcome) AS fingerprints, max(id) AS last_id FROM runs WHERE verdict IS NOT NULL GROUP BY ALL")
def certify(load):
    """Parsers by key with the sorted union of the fingerprints that they were certified on."""
    r = load("runs").where("verdict is not null")
    return r.groupBy("code", "field").agg(F.array_join(F.array_sort(F.collect_set("outcome")), ",").alias("fingerprints"), F.max("id").alias("last_id"))


@query("q_fix_outcome", """WITH b AS (SELECT DISTINCT code, item FROM runs WHERE run_id % 2 = 0 AND red), a AS (SELECT DISTINCT code, item FROM runs WHERE run_id % 2 = 1 AND red), n AS (SELECT code, count(*) AS new_red FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x GROUP BY ALL)
SELECT c.code, coalesce(new_red, 0) AS new_red, CASE WHEN coalesce(new_red, 0) = 0 THEN 'accept' ELSE 'reject' END AS outcome FROM (SELECT DISTINCT code FROM runs) c LEFT JOIN n USING (code)""")
def fix_outcome(load):
    """Red items after a fix that weren't red before: none, and the fix is accepted. Even runs are before, odd ones after."""
    r = load("runs").where("red")
    after, before = (r.where(F.col("run_id") % 2 == i).select("code", "item") for i in (1, 0))
    n = after.subtract(before).groupBy("code").agg(F.count("*").alias("new_red"))
    j = load("runs").select("code").distinct().join(n, "code", "left").withColumn("new_red", F.coalesce("new_red", F.lit(0)))
    return j.withColumn("outcome", F.when(F.col("new_red") == 0, "accept").otherwise("reject"))
