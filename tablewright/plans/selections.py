"""Table selection over the rendered grids and vector recall over the embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.operators import selection as S
from tablewright.operators.grid import DIMENSIONS, TABLE
from tablewright.plans import fieldviews, paging  # noqa: F401  (define the views field_cells and report_page)
from tablewright.plans.base import VIEWS, query
from tablewright.plans.grids import STATS

FACTS = STATS + """, tx AS (SELECT code, year, table_id, string_agg(replace(v, chr(10), ' '), ' ' ORDER BY r, c) AS text FROM cells WHERE v <> '' GROUP BY ALL),
 rc AS (SELECT code, year, table_id, max(r) + 1 AS n_rows FROM cells GROUP BY ALL),
 ag AS (SELECT code, year, table_id, max(n_ratio) AS n_ratio, max(n_money) AS n_money, sum(n_text) AS n_text FROM st GROUP BY ALL),
 sc AS (SELECT code, year, table_id, min(c) FILTER (n_ratio >= 3) AS c FROM st GROUP BY ALL),
 mr AS (SELECT code, year, table_id, max(abs(TRY_CAST(translate(v, '%,', '') AS DOUBLE))) AS max_ratio FROM cells JOIN sc USING (code, year, table_id, c) WHERE contains(v, '%') GROUP BY ALL),
 fc AS (SELECT * FROM tx JOIN rc USING (code, year, table_id) JOIN ag USING (code, year, table_id) LEFT JOIN mr USING (code, year, table_id) LEFT JOIN table_meta USING (code, year, table_id))"""
#: The same over all tables of a report.
ALL_FACTS = FACTS.replace("FROM cells", "FROM all_cells")


def _any_in(column: str, words) -> str:
    return " OR ".join(f"contains({column}, '{w}')" for w in words) or "false"


def _explained_sql(name: str) -> str:
    sig = S.SIGNATURES[name]
    low, high = sig["rows"]
    must = " + ".join(f"CASE WHEN contains(text, '{w}') THEN 25 ELSE 0 END" for w in sig["must"])
    rm = f"CASE WHEN max_ratio > {sig['ratio_max']} THEN -50 ELSE 0 END" if sig["ratio_max"] else "0"
    sections = ", ".join(f"'{x}'" for x in S.SECTIONS[name])
    return f"""SELECT *, must + "exclude" + ratio + amount + label + ratio_max + caption + section AS score, CASE WHEN n_rows NOT BETWEEN {low} AND {high} THEN 'rows' WHEN must = 0 AND caption = 0 THEN 'must' WHEN must + "exclude" + ratio + amount + label + ratio_max + caption + section < 20 THEN 'low' END AS reject FROM (
      SELECT code, year, table_id, '{name}' AS sig, n_rows, {must} AS must, CASE WHEN {_any_in('text', sig['exclude'])} THEN -60 ELSE 0 END AS "exclude", CASE WHEN n_ratio >= 3 THEN 20 ELSE 0 END AS ratio, CASE WHEN n_money >= 3 THEN 15 ELSE 0 END AS amount,
        CASE WHEN n_text >= 5 THEN 10 ELSE 0 END AS label, {rm} AS ratio_max, CASE WHEN coalesce({_any_in('caption', S.CAPTIONS[name])}, false) THEN 40 ELSE 0 END AS caption, CASE WHEN coalesce(section, 'other') IN ({sections}) THEN 20 ELSE -8 END AS section FROM fc) x"""


EXPLAINED = f"WITH {ALL_FACTS}, ex AS (" + " UNION ALL ".join(_explained_sql(n) for n in S.SIGNATURES) + "), rk AS (SELECT code, year, table_id, sig, score, CAST(row_number() OVER (PARTITION BY code, year, sig ORDER BY score DESC, table_id) AS INT) AS rank FROM ex WHERE reject IS NULL)"


@query("q_signature_rank", EXPLAINED + " SELECT * FROM rk")
def signature_rank(load):
    """All six signatures over all tables, with caption and section."""
    return S.scored(S.facts(load("all_cells"), load("table_meta")))


@query("q_score_breakdown", EXPLAINED + """ SELECT code, year, table_id, sig, must, "exclude", ratio, amount, label, ratio_max, caption, section, score, reject FROM ex""")
def score_breakdown(load):
    return S.explained(S.facts(load("all_cells"), load("table_meta")))


_NUM = "CASE WHEN regexp_full_match(trim(translate(v, ',，', ''), ' ' || chr(12288)), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(translate(v, ',，', '') AS DOUBLE) END"
_UNITS = ("1.0", "1e3", "1e4", "1e8")
ERRORS = f"""vx AS (SELECT code, year, table_id, c, {_NUM} AS x, CAST(revenue AS DOUBLE) AS a FROM cells JOIN anchor USING (code, year)),
 er0 AS (SELECT code, year, table_id, c, min(least({', '.join(f'abs(x * {u} - a) / a' for u in _UNITS)})) AS rv, sum(x) AS s, any_value(a) AS a FROM vx WHERE x IS NOT NULL GROUP BY ALL),
 er AS (SELECT code, year, table_id, c, round(least(rv, {', '.join(f'abs(s * {u} - {k} * a) / a' for u in _UNITS for k in range(1, 7))}), 6) AS rel FROM er0),
 an AS (SELECT code, year, table_id, arg_min(c, (rel, c)) AS c, min(rel) AS rel, min(rel) <= 0.03 AS matched FROM er GROUP BY ALL)"""

ALL_ERRORS = ERRORS.replace("FROM cells", "FROM all_cells")


@query("q_anchor_col", f"WITH {ALL_ERRORS} SELECT * FROM er")
def anchor_col(load):
    return S.column_errors(load("all_cells"), load("anchor"))


@query("q_anchor_select", f"WITH {ALL_ERRORS} SELECT * FROM an")
def anchor_select(load):
    return S.anchored(load("all_cells"), load("anchor"))


_DIMS = {}
for _m, _d in DIMENSIONS.items():
    _DIMS.setdefault(_d, []).append(f"contains(v, '{_m}')")
DIMS = "dc AS (SELECT code, year, table_id, " + " + ".join(f"max(CASE WHEN {' OR '.join(m)} THEN 1 ELSE 0 END)" for m in _DIMS.values()) + " AS n_dims FROM cells GROUP BY ALL)"
TRAP = "tp AS (SELECT code, year, table_id, max(coalesce(contains(v, '毛利率'), false)) AND max(coalesce(regexp_matches(v, '比上年|同比'), false)) AS trap FROM cells WHERE r < 4 GROUP BY ALL)"


@query("q_dim_count", f"WITH {DIMS.replace('FROM cells', 'FROM all_cells')} SELECT * FROM dc")
def dim_count(load):
    return S.dimension_counts(load("all_cells"))


@query("q_trap", f"WITH {TRAP.replace('FROM cells', 'FROM all_cells')} SELECT * FROM tp")
def trap(load):
    return S.is_trap(load("all_cells"))


QUESTION = "营业收入构成 分行业 分产品 分地区 销售模式"
_GRAMS = "[" + ", ".join(f"'{g}'" for g in sorted({QUESTION[i : i + 2] for i in range(len(QUESTION) - 1)})) + "]"
_DOCS = r"""dl AS (SELECT *, regexp_replace(v, '[0-9.,%，。、()（）\-—:：\s年]', '', 'g') AS label FROM all_cells), df AS (SELECT code, year, table_id, label, min((r, c)) AS pos FROM dl WHERE len(regexp_extract_all(label, '[一-鿿]')) >= 2 GROUP BY ALL),
 dd AS (SELECT code, year, table_id, string_agg(label, ' ' ORDER BY pos) AS d FROM df GROUP BY ALL), dc0 AS (SELECT code, year, table_id, substr(concat_ws(' ', nullif(trim(caption), ''), d), 1, 300) AS doc FROM dd LEFT JOIN table_meta USING (code, year, table_id)),
 dg AS (SELECT *, list_distinct(list_transform(range(1, length(doc)), lambda i: substr(doc, i, 2))) AS g FROM dc0)"""
RECALLED = f"""{_DOCS}, lk AS (SELECT code, year, table_id, len(list_intersect(g, {_GRAMS})) / sqrt(len(g) * len({_GRAMS})::DOUBLE) AS lik FROM dg),
 rl AS (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY lik DESC, table_id) AS recall FROM lk)"""
_JUDGED = f"""{DIMS.replace("FROM cells", "FROM all_cells")}, {TRAP.replace("FROM cells", "FROM all_cells")}, {ALL_ERRORS}, jd AS (SELECT code, year, table_id, an.c, rel, n_dims, coalesce(trap, false) OR coalesce(contains(caption, '10%以上'), false) AS trap FROM dc LEFT JOIN tp USING (code, year, table_id) LEFT JOIN an USING (code, year, table_id) LEFT JOIN table_meta USING (code, year, table_id))"""
SELECTED = f"""{RECALLED}, {_JUDGED}, tt AS (SELECT *, CASE WHEN coalesce(rel <= 0.05, false) AND NOT trap THEN 0 WHEN coalesce(rel <= 0.05, false) AND n_dims >= 1 THEN 1 WHEN rel IS NOT NULL THEN 2 ELSE 3 END AS tier FROM rl JOIN jd USING (code, year, table_id) WHERE recall <= 8),
 sl AS (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY tier, CASE WHEN tier < 3 THEN -n_dims ELSE 0 END, coalesce(round(rel, 4), 0), recall) AS rn FROM tt)"""


def _docs(load):
    from tablewright.operators.grid import text_doc

    return text_doc(load("all_cells"), load("table_meta"))


@query("q_recall_tables", f"WITH {RECALLED} SELECT code, year, table_id, CAST(recall AS INT) AS recall, round(lik, 6) AS score FROM rl WHERE recall <= 8 AND lik >= 0.05")
def recall_tables(load):
    """The eight tables of a report most like the question."""
    return S.recalled_tables(_docs(load), QUESTION, 8, 0.05).select(*TABLE, "recall", F.round("like", 6).alias("score"))


@query("q_judged", f"WITH {_JUDGED} SELECT * FROM jd")
def judged(load):
    return S.judged(load("all_cells"), load("anchor"), load("table_meta"))


@query("q_recall_judged", f"WITH {RECALLED}, {_JUDGED} SELECT code, year, table_id, CAST(recall AS INT) AS recall, rel, trap FROM rl LEFT JOIN jd USING (code, year, table_id) WHERE recall <= 8")
def recall_judged(load):
    """What is recalled with what the anchor makes of it, by the tables' identity."""
    r = S.recalled_tables(_docs(load), QUESTION).select(*TABLE, "recall")
    return r.join(S.judged(load("all_cells"), load("anchor"), load("table_meta")).select(*TABLE, "rel", "trap"), list(TABLE), "left")


@query("q_select_table", f"WITH {SELECTED} SELECT code, year, table_id, c, n_dims, rel, CASE tier WHEN 0 THEN 'anchor+dims' WHEN 1 THEN 'anchor' WHEN 2 THEN 'nearest' ELSE 'recall' END AS via FROM sl WHERE rn = 1")
def select_table(load):
    """Recall, then the anchor and the dimensions, over all tables of each report."""
    return S.selected(S.recalled_tables(_docs(load), QUESTION), S.judged(load("all_cells"), load("anchor"), load("table_meta")))


@query("q_best_on_page", f"WITH {ERRORS} SELECT code, year, arg_min(table_id, (rel, -table_id)) AS table_id, min(rel) AS rel FROM an GROUP BY ALL")
def best_on_page(load):
    return S.anchored(load("cells"), load("anchor")).groupBy("code", "year").agg(F.min_by("table_id", F.struct("rel", -F.col("table_id"))).alias("table_id"), F.min("rel").alias("rel"))


@query("q_overanchor", f"WITH {TRAP}, {ERRORS} SELECT code, year, table_id, rel FROM (SELECT an.*, row_number() OVER (PARTITION BY code, year ORDER BY rel, table_id) AS rn FROM an JOIN tp USING (code, year, table_id) WHERE NOT trap AND matched AND table_id <> 3) x WHERE rn <= 2")
def overanchor(load):
    """Other tables that the anchor confirms: no traps, no excluded tables, the first two."""
    t = S.anchored(load("cells"), load("anchor")).join(S.is_trap(load("cells")), list(TABLE)).where("not trap and matched and table_id <> 3")
    return t.withColumn("rn", F.row_number().over(Window.partitionBy("code", "year").orderBy("rel", "table_id"))).where("rn <= 2").select(*TABLE, "rel")


@query("q_result_preview", EXPLAINED + " SELECT code, year, sig, table_id, score FROM rk WHERE rank = 1")
def result_preview(load):
    """The first table of each field."""
    return S.scored(S.facts(load("all_cells"), load("table_meta"))).where("rank = 1").select("code", "year", "sig", "table_id", "score")


_RECALL = """WITH q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT qid, e.vec_id, list_cosine_similarity(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(q, lambda x: CAST(x AS DOUBLE))) AS sim FROM embeddings e CROSS JOIN q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS INT) AS rank, max(sim) OVER (PARTITION BY qid) AS best FROM s) """


@query("q_vector_recall", _RECALL + "SELECT qid, vec_id, round(sim, 4) AS score, rank FROM r WHERE rank <= 6 AND (sim >= 0.5 OR best < 0.5)")
def vector_recall(load):
    e = load("embeddings")
    return S.recalled(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), e, 6, 0.5)


@query("q_vector_query", _RECALL + "SELECT qid, vec_id, round(sim, 4) AS score, rank FROM r WHERE rank <= 5 AND sim > 0.3")
def vector_query(load):
    e = load("embeddings")
    return S.recalled(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), e, 5, 0.3, fallback=False)


VIEWS["certified"] = "SELECT CAST(label AS INT) AS parser, CASE WHEN label % 4 = 3 THEN NULL ELSE CAST(label % 3 AS INT) END AS print FROM embeddings GROUP BY label"


@query("q_candidates", """WITH r AS (SELECT code, year, CAST(n_lines % 5 AS INT) AS print FROM reports), j AS (SELECT r.code, r.year, c.parser, c.print IS NOT DISTINCT FROM r.print AS hit FROM r CROSS JOIN certified c),
w AS (SELECT *, max(hit) OVER (PARTITION BY code, year) AS anyhit FROM j) SELECT code, year, count(*) AS n, CAST(min(parser) AS INT) AS first_parser FROM w WHERE hit OR NOT anyhit GROUP BY ALL""")
def candidates(load):
    """Parsers certified for a report's fingerprint, all of them where none is; the catalog is a handful of rows."""
    r = load("reports").select("code", "year", (F.col("n_lines") % 5).cast("int").alias("rp"))
    j = r.crossJoin(F.broadcast(load("certified"))).withColumn("hit", F.coalesce(F.col("print") == F.col("rp"), F.lit(False)))
    w = j.withColumn("any", F.max("hit").over(Window.partitionBy("code", "year"))).where("hit or not any")
    return w.groupBy("code", "year").agg(F.count("*").alias("n"), F.min("parser").alias("first_parser"))


@query("q_rnd_pick", EXPLAINED + """, rm AS (SELECT code, year, table_id, rank, n_rows, contains(text, '研发材料') OR contains(text, '职工薪酬') AS detail FROM rk JOIN fc USING (code, year, table_id) WHERE sig = 'rnd')
SELECT code, year, table_id, CAST(n_rows AS BIGINT) AS n_rows, detail FROM (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY detail DESC, n_rows DESC, rank) AS rn FROM rm) x WHERE rn = 1""")
def rnd_pick(load):
    """The R&D table of each report: of those that pass its signature, the ones with detail accounts before the rest."""
    return S.rnd_target(S.facts(load("all_cells"), load("table_meta"))).withColumn("n_rows", F.col("n_rows").cast("bigint"))


@query("q_select_parser", "SELECT code, year, CASE WHEN (SELECT sum((length(text) - length(replace(text, '非利息净收入', ''))) / 6) FROM report_page p WHERE p.code = r.code AND p.year = r.year AND page <= 80) >= 2 THEN 'bank' ELSE 'default' END AS parser FROM reports r")
def select_parser(load):
    """The parser that is surest of a report: bank at 0.9 or 0.3 against the default's 0.5."""
    from tablewright.operators.pages import bank_score

    return bank_score(load("report_page")).select("code", "year", F.when(F.col("confidence") > 0.5, "bank").otherwise("default").alias("parser"))
