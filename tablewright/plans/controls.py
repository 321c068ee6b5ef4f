"""Vector index, batch control, anchors from statements, text evidence, surroundings of tables, sampled clusters."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.operators import anchors as A
from tablewright.operators import batches, checks, context, evidence, experience, profiles, vectors
from tablewright.operators import reconcile as R
from tablewright.operators import selection as S
from tablewright.operators.grid import TABLE, text_doc
from tablewright.plans import paging, variants
from tablewright.plans.base import ORACLES, VIEWS, query
from tablewright.plans.revenue import CONFIDENCE_SQL
from tablewright.plans.selections import _RECALL, QUESTION, SELECTED
from tablewright.session import shared_folder


def _queries(e):
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


@query("q_vector_index", _RECALL + "SELECT count(*) AS n_exact, true AS recall_reached FROM r WHERE rank <= 6 AND sim >= 0.5")
def vector_index(load):
    """The stated queries against the index of all vectors: whether it finds 0.9 or more of what the exact search finds."""
    e = load("embeddings")
    exact = S.recalled(_queries(e), e, 6, 0.5, fallback=False).select("qid", "vec_id")
    index = vectors.build(e)
    found = vectors.search(index, _queries(e), 6, 0.5, probes=max(1, len(index.centres) // 3)).select("qid", "vec_id", F.lit(1).alias("hit"))
    n = exact.join(found, ["qid", "vec_id"], "left").agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"))
    return n.select("n_exact", (F.col("n_found") >= 0.9 * F.col("n_exact")).alias("recall_reached"))


@query("q_semantic_check", """WITH s AS (SELECT q.vec_id AS qid, max(list_cosine_similarity(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)))) AS sim FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT qid, CASE WHEN sim > 0.3 THEN round(sim, 4) ELSE 0.0 END AS similarity, coalesce(round(sim, 4) >= 0.6, false) AS passed, CASE WHEN round(sim, 4) >= 0.6 THEN 'pass' ELSE 'new_parser' END AS suggest FROM s""")
def semantic_check(load):
    """How like the nearest other vector each of the stated ones is, by the index, all of whose lists are looked into."""
    e = load("embeddings")
    index = vectors.build(e)
    return vectors.semantic_checks(_queries(e), vectors.search(index, _queries(e), 1, 0.3, probes=len(index.centres), itself=False))


@query("q_batch_run", CONFIDENCE_SQL + "SELECT confidence AS status, count(*) AS n FROM conf GROUP BY ALL")
def batch_run(load):
    """All reports judged in four buckets under a control file; what the finished buckets hold."""
    reports = load("reports").select("code", "year")
    spark = reports.sparkSession
    folder = f"{shared_folder(spark)}/batch-{uuid.uuid4().hex}"
    control = batches.Control(spark, folder)
    pred, anchor = load("pred"), load("anchor")
    batches.run(spark, control, reports, lambda part: R.confidence(pred.join(part, ["code", "year"], "left_semi"), anchor).select("code", "year", F.col("confidence").alias("status")), f"{folder}/out", 4)
    return batches.results(spark, control, f"{folder}/out").groupBy("status").agg(F.count("*").alias("n"))


#: Table 11 is an income statement, in some reports after another table that only speaks of revenue.
VIEWS["statement_cells"] = """
    SELECT code, year, table_id, r, c, CASE c WHEN 0 THEN name WHEN 1 THEN this WHEN 2 THEN last END AS v FROM (
      SELECT code, year, 11 AS table_id, 0 AS r, '项目' AS name, '本期' AS this, '上期' AS last FROM anchor WHERE year % 7 <> 3
      UNION ALL SELECT code, year, 11, 1, '一、营业总收入', @money(revenue + 5), @money(revenue) FROM anchor WHERE year % 7 <> 3
      UNION ALL SELECT code, year, 11, 2, '其中：营业收入', CASE WHEN year % 3 = 0 THEN '' WHEN year % 3 = 1 THEN '-' ELSE @money(revenue) END, CASE WHEN year % 3 = 1 THEN '' ELSE @money(revenue - 1) END FROM anchor WHERE year % 7 <> 3
      UNION ALL SELECT code, year, 11, 3, ' 营业收入 ：', @money(revenue + 2), NULL FROM anchor WHERE year % 7 <> 3
      UNION ALL SELECT code, year, 11, 4, '二、营业总成本', @money(cost + 7), NULL FROM anchor WHERE year % 7 <> 3
      UNION ALL SELECT code, year, 11, 5, '其中：营业成本', @money(cost), '-5.00' FROM anchor WHERE year % 7 <> 3 AND year % 5 <> 1
      UNION ALL SELECT code, year, 12, 0, '营业总收入', '1.00', NULL FROM anchor UNION ALL SELECT code, year, 12, 1, '营业成本', '3.00', '4.00' FROM anchor) s
    CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2) n"""
VIEWS["database"] = "SELECT code, year, CASE WHEN k = 2 THEN CAST(-1 AS DOUBLE) WHEN k = 3 THEN NULL ELSE CAST(revenue AS DOUBLE) END AS revenue, CASE WHEN k = 4 THEN NULL ELSE CAST(cost AS DOUBLE) END AS cost FROM anchor JOIN reports USING (code, year) WHERE NOT (k = 6 AND year % 2 = 0)"
STATEMENTS = f"""m0 AS (SELECT code, year, table_id, r, string_agg(coalesce(v, ''), '' ORDER BY c) AS t, list(coalesce(v, '') ORDER BY c) AS x FROM statement_cells GROUP BY ALL),
 f0 AS (SELECT code, year, min(table_id) FILTER (contains(t, '营业总收入')) AS table_id FROM m0 GROUP BY ALL),
 l0 AS (SELECT code, year, r, list_filter(list_transform(x, lambda y: translate(y, ' 　：:', '')), lambda y: y <> '')[1] AS name, list_filter(list_transform(x, lambda y: {variants._money('y')}), lambda y: y > 0)[1] AS m FROM m0 JOIN f0 USING (code, year, table_id)),
 ds AS (SELECT code, year, arg_min(m, r) FILTER (ends_with(name, '营业收入')) AS revenue, arg_min(m, r) FILTER (ends_with(name, '营业成本')) AS cost FROM l0 WHERE m IS NOT NULL AND NOT contains(name, '总') GROUP BY ALL HAVING count(*) FILTER (ends_with(name, '营业收入') OR ends_with(name, '营业成本')) > 0)"""


@query("q_anchor_tables", f"WITH {STATEMENTS} SELECT * FROM ds")
def anchor_tables(load):
    """Revenue and cost from each report's first income statement."""
    return A.from_tables(load("statement_cells"))


@query("q_anchor_filled", f"""WITH {STATEMENTS} SELECT coalesce(d.code, t.code) AS code, coalesce(d.year, t.year) AS year,
 concat_ws(',', CASE WHEN (d.revenue > 0) IS NOT TRUE AND t.revenue IS NOT NULL THEN 'revenue' END, CASE WHEN (d.cost > 0) IS NOT TRUE AND t.cost IS NOT NULL THEN 'cost' END) AS from_tables,
 coalesce(CASE WHEN d.revenue > 0 THEN d.revenue END, t.revenue) AS revenue, coalesce(CASE WHEN d.cost > 0 THEN d.cost END, t.cost) AS cost FROM database d FULL JOIN ds t ON d.code = t.code AND d.year = t.year""")
def anchor_filled(load):
    """The database's anchors with their gaps filled from income statements."""
    return A.filled(load("database"), A.from_tables(load("statement_cells")))


_ITEMS = " UNION ALL ".join((
    f"SELECT 'revenue_breakdown' AS field, code, year, dim, name, ratio FROM ({ORACLES['q_v_buckets']}) a",
    f"SELECT 'rnd_info', code, year, dim, name, NULL FROM ({ORACLES['q_v_rnd']}) b WHERE dim = 'detail'",
    f"SELECT 'employees', code, year, dim, name, NULL FROM ({ORACLES['q_v_staff']}) c",
    f"SELECT 'cost_breakdown', code, year, dim, name, ratio FROM ({ORACLES['q_v_costs']}) d",
    f"SELECT 'top_clients', code, year, dim, name, ratio FROM ({ORACLES['q_v_clients']}) e",
    f"SELECT 'top_suppliers', code, year, dim, name, ratio FROM ({ORACLES['q_v_suppliers']}) f",
))
_SAID = " UNION ALL ".join(f"SELECT code, year, '{f}' AS field, count(*) FILTER ({' OR '.join(f'contains(text, {chr(39)}{w}{chr(39)})' for w in words)}) AS n_pages, min(page) FILTER ({' OR '.join(f'contains(text, {chr(39)}{w}{chr(39)})' for w in words)}) AS first_page FROM report_page GROUP BY ALL" for f, words in evidence.WORDS.items())
_FOREIGN = "CASE field " + " ".join(f"WHEN '{f}' THEN " + " + ".join(f"CAST(contains(name, '{w}') AS INT)" for w in words) for f, (words, _) in evidence.FOREIGN.items()) + " ELSE 0 END"
_LEAST = "CASE field " + " ".join(f"WHEN '{f}' THEN {least}" for f, (_, least) in evidence.FOREIGN.items()) + " END"


@query("q_text_checks", f"""WITH im AS ({_ITEMS}), sd AS ({_SAID}), bk AS (SELECT code, year FROM ({ORACLES['q_select_parser']}) b WHERE parser = 'bank'),
 n AS (SELECT code, year, field, count(*) AS n_items, sum({_FOREIGN}) FILTER (field <> 'revenue_breakdown' OR dim = 'segments') AS fo, round(sum(ratio) FILTER (field <> 'revenue_breakdown' OR dim = 'segments'), 2) AS q FROM im GROUP BY ALL),
 j AS (SELECT sd.*, coalesce(n_items, 0) AS n_items, coalesce(fo >= {_LEAST.replace("CASE field", "CASE sd.field")}, false) AS foreign_names, q, bk.code IS NOT NULL AND sd.field = 'rnd_info' AS bank FROM sd LEFT JOIN n USING (code, year, field) LEFT JOIN bk USING (code, year))
SELECT code, year, field, n_items, n_pages, first_page, CASE WHEN n_items = 0 THEN CASE WHEN n_pages > 0 AND NOT bank THEN 'missing' ELSE 'absent' END WHEN bank OR foreign_names OR (field = 'rnd_info' AND n_items > 15) THEN 'mismatch'
 WHEN n_pages = 0 AND field = 'cost_breakdown' THEN 'unsupported' WHEN field IN ('revenue_breakdown', 'cost_breakdown') AND coalesce(q > 0 AND NOT (q > 98 AND q < 102), false) THEN 'column' ELSE 'ok' END AS verdict FROM j""")
def text_checks(load):
    """Every field of every report against what its pages say."""
    tagged = lambda field, df, ratio=True: df.select(F.lit(field).alias("field"), "code", "year", "dim", "name", (F.col("ratio") if ratio else F.lit(None)).cast("double").alias("ratio"))
    items = tagged("revenue_breakdown", variants.buckets(load))
    more = [
        tagged("rnd_info", variants.rnd_details(load).where("dim = 'detail'"), False), tagged("employees", variants.staff_lists(load), False),
        tagged("cost_breakdown", variants.flat_costs(load)), tagged("top_clients", variants.partners(load, "client")), tagged("top_suppliers", variants.partners(load, "supplier")),
    ]
    for x in more:
        items = items.unionByName(x)
    from tablewright.operators.pages import bank_score

    return evidence.checked(items, load("report_page"), bank_score(load("report_page")).where("confidence > 0.5"))


VIEWS["standing"] = """
    SELECT m.code, m.year, m.table_id, s.page, CAST(60 + 200 * (m.table_id % 3) AS DOUBLE) AS top, CAST(60 + 200 * (m.table_id % 3) + 14 * n AS DOUBLE) AS bottom, CAST(750 AS DOUBLE) AS page_h, caption
    FROM table_meta m JOIN sheets s ON s.code = m.code AND s.year = m.year AND s.table_id = m.table_id JOIN (SELECT code, year, table_id, max(r) + 1 AS n FROM all_cells GROUP BY code, year, table_id) q ON q.code = m.code AND q.year = m.year AND q.table_id = m.table_id"""
_SHOWN = f"""pk AS (SELECT code, year, table_id, page FROM sl JOIN standing USING (code, year, table_id) WHERE rn = 1),
 w0 AS (SELECT code, year, table_id, r, list(trim(replace(coalesce(v, ''), chr(10), '')) ORDER BY c) AS x FROM all_cells GROUP BY ALL),
 w1 AS (SELECT code, year, table_id, len(x) AS w, count(*) AS n, min(r) AS f FROM w0 GROUP BY ALL), w2 AS (SELECT code, year, table_id, arg_max(w, (n, -f)) AS n_cols FROM w1 GROUP BY ALL),
 w3 AS (SELECT code, year, table_id, count(*) AS n_rows, arg_min(array_to_string(list_transform(x, lambda y: y[:24]), ' | '), r) AS row0 FROM w0 GROUP BY ALL),
 tb AS (SELECT * FROM standing JOIN w2 USING (code, year, table_id) JOIN w3 USING (code, year, table_id))"""


def _shown(load):
    cells, meta = load("all_cells"), load("table_meta")
    first = S.selected(S.recalled_tables(text_doc(cells, meta), QUESTION), S.judged(cells, load("anchor"), meta))
    standing = load("standing")
    return first.select(*TABLE).join(standing.select(*TABLE, "page"), list(TABLE)), context.described(cells, standing), cells


@query("q_neighbor_lines", f"""WITH {SELECTED}, {_SHOWN}, nb AS (SELECT pk.code, pk.year, pk.table_id AS picked, tb.*, row_number() OVER (PARTITION BY pk.code, pk.year, pk.table_id ORDER BY tb.page, top, tb.table_id) AS n FROM pk JOIN tb ON tb.code = pk.code AND tb.year = pk.year AND tb.page BETWEEN pk.page - 1 AND pk.page + 1)
SELECT code, year, picked, CAST(n AS INT) AS n, table_id, printf('p%d rows=%d cols=%d%s cap=%s row0=[%s]', page, n_rows, n_cols, CASE WHEN bottom >= page_h - 90 THEN ' near_bottom=Y' ELSE '' END, trim(coalesce(caption, ''))[:60], row0) AS line FROM nb WHERE n <= 12""".replace("pk.table_id AS picked, tb.*,", "pk.table_id AS picked, tb.table_id, tb.page, n_rows, n_cols, bottom, page_h, caption, row0,"))
def neighbor_lines(load):
    """A line for each table on the chosen one's page and the pages beside it."""
    picks, tables, _ = _shown(load)
    return context.neighbour_lines(picks, tables)


@query("q_next_content", f"""WITH {SELECTED}, {_SHOWN}, od AS (SELECT *, lead(table_id) OVER w AS next_id, lead(printf('p%d rows=%d cols=%d%s cap=%s', page, n_rows, n_cols, CASE WHEN top <= 120 THEN ' top_of_page=Y' ELSE '' END, trim(coalesce(caption, ''))[:80])) OVER w AS head FROM tb WINDOW w AS (PARTITION BY code, year ORDER BY page, top, table_id)),
 us AS (SELECT *, max(coalesce(v <> '', false)) OVER (PARTITION BY code, year, table_id, c) AS used FROM all_cells WHERE r < 25),
 ln AS (SELECT code, year, table_id, r, string_agg(coalesce(replace(v, chr(10), ' '), ''), ' | ' ORDER BY c) AS line FROM us WHERE used GROUP BY ALL HAVING max(coalesce(v <> '', false))), ct AS (SELECT code, year, table_id AS next_id, string_agg(line, chr(10) ORDER BY r) AS content FROM ln GROUP BY ALL)
SELECT od.code, od.year, od.table_id, next_id, head, coalesce(content, '') AS content FROM od JOIN pk USING (code, year, table_id) LEFT JOIN ct USING (code, year, next_id) WHERE next_id IS NOT NULL""")
def next_content(load):
    """The table after the chosen one, whole."""
    picks, tables, cells = _shown(load)
    return context.following_content(picks, tables, cells)


@query("q_sampled_survey", f"""WITH pr AS ({ORACLES['q_fingerprint']}), {CONFIDENCE_SQL.strip()[5:]}, sm AS (SELECT code, year, hash, row_number() OVER (PARTITION BY hash ORDER BY md5(code || '/' || year), code, year) AS n, count(*) OVER (PARTITION BY hash) AS size FROM pr)
SELECT hash, any_value(size) AS size, count(*) AS sampled, count(*) FILTER (confidence = 'high') AS passed, round(count(*) FILTER (confidence = 'high') / count(*), 4) AS pass_rate FROM sm LEFT JOIN conf USING (code, year) WHERE n <= 3 GROUP BY hash""")
def sampled_survey(load):
    """Three reports of each layout by their hash, joined to what a baseline run says of them: how often each layout passes."""
    prints = paging.fingerprint(load)
    order = Window.partitionBy("hash").orderBy(F.md5(F.concat_ws("/", "code", "year")), "code", "year")
    some = prints.select("code", "year", "hash", F.row_number().over(order).alias("n"), F.count("*").over(Window.partitionBy("hash")).alias("size")).where("n <= 3")
    passes = R.confidence(load("pred"), load("anchor")).select("code", "year", (F.col("confidence") == "high").alias("pass"))
    j = some.join(passes, ["code", "year"], "left")
    return j.groupBy("hash").agg(F.first("size").alias("size"), F.count("*").alias("sampled"), F.count_if("pass").alias("passed"), F.round(F.count_if("pass") / F.count("*"), 4).alias("pass_rate"))


VIEWS["own_profiles"] = "SELECT code, year, CAST(10 + n AS INT) AS page, CASE WHEN n = 2 THEN 'cost_breakdown' WHEN n = 3 THEN CAST(NULL AS STRING) ELSE 'revenue_breakdown' END AS field, concat('own', CAST((k + n) % 3 AS STRING)) AS profile, (year + n) % 3 = 0 AS synced FROM reports CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3) x WHERE k % 2 = 0"
VIEWS["layout_profiles"] = "SELECT 'revenue_breakdown' AS field, CAST(p AS INT) AS print, CAST(10 + n AS INT) AS page, concat('layout', CAST(n AS STRING)) AS profile FROM (SELECT DISTINCT n_lines % 5 AS p FROM reports) q CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 4) x WHERE p <> 3"
VIEWS["profile_log"] = "SELECT code, year, 'revenue_breakdown' AS field, CAST(14 AS INT) AS page FROM reports WHERE year % 4 = 1"
VIEWS["page_tables"] = "SELECT code, year, CAST(10 + n AS INT) AS page, CAST(n * 10 + m AS INT) AS table_id FROM reports CROSS JOIN (SELECT 1 AS n UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) x CROSS JOIN (SELECT 1 AS m UNION ALL SELECT 2) y"
VIEWS["page_rescans"] = "SELECT code, year, page, profile, CAST(500 + page AS INT) AS table_id FROM (SELECT code, year, page, profile FROM own_profiles UNION SELECT r.code, r.year, l.page, l.profile FROM reports r JOIN layout_profiles l ON l.print = r.n_lines % 5) z WHERE (year + page) % 4 <> 0"
_PENDING = """mn AS (SELECT code, year, page, min(profile) AS profile FROM own_profiles WHERE NOT synced AND coalesce(field = 'revenue_breakdown', true) GROUP BY ALL),
 th AS (SELECT r.code, r.year, l.page, l.profile FROM reports r JOIN layout_profiles l ON l.print = r.n_lines % 5 ANTI JOIN mn ON mn.code = r.code AND mn.year = r.year AND mn.page = l.page ANTI JOIN profile_log g ON g.code = r.code AND g.year = r.year AND g.page = l.page),
 td AS (SELECT code, year, page, profile, 'report' AS source FROM mn UNION ALL SELECT code, year, page, profile, 'fingerprint' FROM th)"""


def _pending(load):
    reports = load("reports").select("code", "year", (F.col("n_lines") % 5).cast("int").alias("print"))
    return profiles.pending(reports, load("own_profiles"), load("layout_profiles"), load("profile_log"), "revenue_breakdown")


@query("q_profile_pending", f"WITH {_PENDING} SELECT * FROM td")
def profile_pending(load):
    """Pages that a kept profile has still to be applied to: a report's own before its layout's."""
    return _pending(load)


@query("q_profile_applied", f"""WITH {_PENDING}, nw AS (SELECT r.* FROM page_rescans r SEMI JOIN td USING (code, year, page, profile)), pg AS (SELECT DISTINCT code, year, page FROM nw),
 pt AS (SELECT code, year, page, table_id FROM page_tables ANTI JOIN pg USING (code, year, page) UNION ALL SELECT code, year, page, table_id FROM nw), lg AS (SELECT code, year, count(*) AS n_applied FROM td SEMI JOIN pg USING (code, year, page) GROUP BY ALL)
SELECT code, year, count(*) AS n_tables, CAST(sum(table_id) AS BIGINT) AS ids, coalesce(any_value(n_applied), 0) AS n_applied FROM pt LEFT JOIN lg USING (code, year) GROUP BY ALL""")
def profile_applied(load):
    """Reports after their pending profiles: how many tables they have, and how many pages were patched."""
    patched, log = profiles.applied(load("page_tables").select("code", "year", "page", "table_id"), load("page_rescans"), _pending(load), "revenue_breakdown")
    n = log.groupBy("code", "year").agg(F.count("*").alias("n_applied"))
    t = patched.groupBy("code", "year").agg(F.count("*").alias("n_tables"), F.sum("table_id").alias("ids"))
    return t.join(n, ["code", "year"], "left").select("code", "year", "n_tables", "ids", F.coalesce("n_applied", F.lit(0)).alias("n_applied"))


_RATIO = {"clients": ORACLES["q_v_clients"], "suppliers": ORACLES["q_v_suppliers"]}
CHECKS = f"""cl AS ({_RATIO['clients']}), su AS ({_RATIO['suppliers']}),
 rv0 AS (SELECT r.code, r.year, d.dim, count(s.name) AS n, round(sum(ratio), 2) AS s FROM reports r CROSS JOIN (VALUES ('segments'), ('industries'), ('regions'), ('by_channel')) AS d(dim) LEFT JOIN shared s ON s.code = r.code AND s.year = r.year AND s.dim = d.dim GROUP BY r.code, r.year, d.dim),
 rv AS (SELECT *, sum(n) OVER (PARTITION BY code, year) AS alls FROM rv0),
 rn AS (SELECT r.code, r.year, count(x.name) AS n, coalesce(CAST(sum(amount) AS DOUBLE), 0) AS s, any_value(CAST(total AS DOUBLE)) AS t FROM reports r LEFT JOIN (SELECT * FROM rnd WHERE k <> 1) x ON x.code = r.code AND x.year = r.year LEFT JOIN rnd_total t ON t.code = r.code AND t.year = r.year GROUP BY r.code, r.year),
 em AS (SELECT r.code, r.year, any_value(total) AS t, sum(n) FILTER (dim = 'composition') AS c, sum(n) FILTER (dim = 'education') AS e FROM reports r LEFT JOIN (SELECT * FROM emp_total WHERE year % 4 <> 0) t ON t.code = r.code AND t.year = r.year LEFT JOIN emp x ON x.code = r.code AND x.year = r.year GROUP BY r.code, r.year),
 ca AS (SELECT r.code, r.year, count(dim) FILTER (dim <> 'total') AS n, round(sum(coalesce(ratio, 0)) FILTER (dim <> 'total'), 4) AS s, coalesce(any_value(ratio) FILTER (dim = 'total'), 0) AS t FROM reports r LEFT JOIN cl ON cl.code = r.code AND cl.year = r.year GROUP BY r.code, r.year),
 ck AS (SELECT DISTINCT code, year, 'revenue_breakdown' AS field, 'MISSING' AS status FROM rv WHERE alls = 0
  UNION ALL SELECT code, year, 'revenue_breakdown.' || dim, CASE WHEN n = 0 THEN 'EMPTY' ELSE 'SUSPICIOUS' END FROM rv WHERE alls > 0 AND dim <> 'by_channel' AND (n = 0 OR s < 80 OR s > 120)
  UNION ALL SELECT code, year, 'revenue_breakdown.' || dim || '.' || name, 'ERROR' FROM shared WHERE ratio > 100 AND dim <> 'by_channel'
  UNION ALL SELECT code, year, 'rnd_info', 'MISSING' FROM rn WHERE n = 0
  UNION ALL SELECT code, year, 'rnd_info.total_this', CASE WHEN abs(s - t) / greatest(t, 1) * 100 <= 5 THEN 'PASS' ELSE 'SUSPICIOUS' END FROM rn WHERE n > 0 AND t <> 0
  UNION ALL SELECT code, year, 'rnd_info.detail_count', CASE WHEN n BETWEEN 3 AND 20 THEN 'PASS' ELSE 'SUSPICIOUS' END FROM rn WHERE n > 0
  UNION ALL SELECT code, year, 'employees', 'MISSING' FROM em WHERE coalesce(t, 0) = 0
  UNION ALL SELECT code, year, 'employees.composition', CASE WHEN abs(c - t) > 10 THEN 'SUSPICIOUS' ELSE 'PASS' END FROM em WHERE t <> 0 AND c IS NOT NULL
  UNION ALL SELECT code, year, 'employees.education', 'SUSPICIOUS' FROM em WHERE t <> 0 AND abs(e - t) > 10
  UNION ALL SELECT code, year, 'top_clients', CASE WHEN n = 0 THEN 'MISSING' ELSE 'SUSPICIOUS' END FROM ca WHERE n = 0 OR round(abs(t - s), 4) > 1
  UNION ALL SELECT code, year, 'top_suppliers', 'MISSING' FROM reports r ANTI JOIN (SELECT * FROM su WHERE dim <> 'total') x ON x.code = r.code AND x.year = r.year)"""


def _issues(load):
    reports = load("reports")
    parts = (
        checks.revenue(reports, load("shared")), checks.rnd(reports, load("rnd").where("k <> 1"), load("rnd_total")),
        checks.employees(reports, load("emp"), load("emp_total").where("year % 4 <> 0")), checks.partners(reports, variants.partners(load, "client"), variants.partners(load, "supplier")),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("q_result_checks", f"WITH {CHECKS} SELECT * FROM ck")
def result_checks(load):
    """The four checkers over all reports: here some reports have no R&D details and some no head count."""
    return _issues(load)


@query("q_check_summary", f"WITH {CHECKS} SELECT code, year, count(*) AS total_checks, " + ", ".join(f"count(*) FILTER (status = '{k}') AS n_{k.lower()}" for k in ("PASS", "SUSPICIOUS", "ERROR", "MISSING", "EMPTY")) + " FROM ck GROUP BY ALL")
def check_summary(load):
    return checks.summary(_issues(load))


VIEWS["fixes"] = "SELECT event_id AS id, CAST(user_id % 50 AS STRING) AS code, event_type AS field, concat('fix', CAST(user_id % 3 AS STRING)) AS fix FROM events WHERE user_id % 4 <> 0"
VIEWS["fix_cases"] = "SELECT DISTINCT CAST(user_id % 50 AS STRING) AS code, event_type AS field FROM events UNION SELECT 'none' AS code, 'unheard of' AS field FROM events"
_KNOWN = "kn AS (SELECT code, field, fix, count(*) AS hits, min(id) AS first FROM fixes GROUP BY ALL)"


@query("q_known_fix", f"""WITH {_KNOWN}, ow AS (SELECT code, field, arg_min(fix, first) AS own FROM kn GROUP BY ALL), cm AS (SELECT field, arg_min(fix, (-hits, first)) AS common FROM kn GROUP BY ALL)
SELECT code, field, coalesce(own, common) AS fix, CASE WHEN own IS NOT NULL THEN 'exact' WHEN common IS NOT NULL THEN 'field' END AS source FROM fix_cases LEFT JOIN ow USING (code, field) LEFT JOIN cm USING (field)""")
def known_fix(load):
    """What to try first for each case: its own fix, or its field's commonest."""
    return experience.known_fix(load("fix_cases"), experience.recorded(load("fixes")))


@query("q_top_fixes", f"WITH {_KNOWN} SELECT CAST(row_number() OVER (ORDER BY hits DESC, first) AS INT) AS rank, code, field, fix, hits FROM kn WHERE hits > 1 QUALIFY rank <= 5")
def top_fixes(load):
    return experience.top_fixes(experience.recorded(load("fixes")))


#: Candidate rules of each report: three years stand for three of them, the least year for the rule in force.
VIEWS["rule_trials"] = "SELECT code, year, red_count FROM (SELECT code, year, CAST(n_lines % 4 AS BIGINT) AS red_count FROM reports) q"
_FIELDS3 = "list_filter(['revenue', 'cost', 'rnd'], lambda x: CASE x WHEN 'revenue' THEN red_count >= 1 WHEN 'cost' THEN red_count >= 2 ELSE red_count >= 3 END)"


@query("q_best_candidate", f"""WITH t AS (SELECT *, {_FIELDS3} AS f, year = min(year) OVER (PARTITION BY code) AS base FROM rule_trials), b AS (SELECT * FROM t WHERE base),
 j AS (SELECT a.code, a.year AS candidate, a.red_count, (b.red_count = 0 AND a.red_count > 0) OR len(list_filter(a.f, lambda x: NOT list_contains(b.f, x))) > 0 AS worse, (b.red_count > 0 AND a.red_count = 0) OR a.red_count < b.red_count AS better FROM t a JOIN b ON b.code = a.code WHERE NOT a.base)
SELECT code, count(*) AS evaluated, count(*) FILTER (better AND NOT worse) > 0 AS accepted, arg_min(candidate, (red_count, candidate)) FILTER (better AND NOT worse) AS candidate FROM j GROUP BY code""")
def best_candidate(load):
    """Of all candidate rules of a report the accepted one with fewest reds."""
    reds = F.array(*(F.when(F.col("red_count") >= i, f) for i, f in enumerate(("revenue", "cost", "rnd"), 1)))
    t = load("rule_trials").withColumn("red_fields", F.array_compact(reds)).withColumn("passed", F.col("red_count") == 0).withColumn("base", F.col("year") == F.min("year").over(Window.partitionBy("code")))
    return experience.best_candidate(experience.accepted(t.where("base"), t.where("not base").withColumnRenamed("year", "candidate")))
