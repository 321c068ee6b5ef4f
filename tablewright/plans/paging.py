"""Queries on page text."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.operators import grid as G
from tablewright.operators import pages as P
from tablewright.plans.base import VIEWS, query

VIEWS["report_page"] = """
    SELECT code, year, k, CAST(row_number() OVER (PARTITION BY code, year ORDER BY l_orderkey, l_linenumber) AS INT) AS page,
      concat(CASE (l_orderkey * 7 + l_linenumber) % 23 WHEN 0 THEN '第三节 管理层讨论与分析' WHEN 1 THEN '第四节公司治理' WHEN 2 THEN '第十节 财务报告' WHEN 3 THEN '财务报表附注' WHEN 4 THEN '目录 管理层......3 治理......9 财务......20 第四节公司治理'
          WHEN 5 THEN '分产品 营业收入' WHEN 6 THEN '研发投入 职工薪酬' WHEN 7 THEN '前五名客户' WHEN 8 THEN '第十一节 备查文件' WHEN 9 THEN '专业构成 教育程度' WHEN 10 THEN '前五名供应商' WHEN 11 THEN '营业收入构成' ELSE '正文' END,
        CASE WHEN k = 2 AND l_linenumber % 2 = 0 THEN ' 非利息净收入 利息净收入' WHEN k = 3 AND l_linenumber = 1 THEN ' 已赚保费 退保金' WHEN k = 4 AND l_linenumber = 2 THEN ' 手续费及佣金净收入 证券经纪业务' ELSE '' END) AS text FROM fact"""
VIEWS["outline"] = """
    SELECT code, year, CAST(1 + page % 2 AS INT) AS level, page, CASE page % 5 WHEN 0 THEN '第三节 管理层讨论与分析' WHEN 1 THEN '第十节 财务报告' WHEN 2 THEN '第四节 公司治理' WHEN 3 THEN '释义' ELSE '备查文件目录' END AS title FROM report_page WHERE page % 7 = 3"""

SECTION = """sec AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY code, year ORDER BY page), 'other') AS section FROM (SELECT *, CASE WHEN len(regexp_extract_all(text, '[.·。．…]{4,}')) >= 3 THEN NULL
  WHEN regexp_matches(text, '第[一二三四五六七八九十]+节\\s*(管理层讨论与分析|经营情况讨论与分析|董事会报告)') THEN 'management' WHEN regexp_matches(text, '第[一二三四五六七八九十]+节\\s*公司治理') THEN 'gov'
  WHEN regexp_matches(text, '第[一二三四五六七八九十]+节\\s*财务报[告表]') THEN 'fuzhu' WHEN regexp_matches(text, '财务报表附注|会计报表附注') THEN 'fuzhu' WHEN regexp_matches(text, '第[一二三四五六七八九十]+节\\s*备查文件') THEN 'other' END AS mark FROM report_page) m)"""


@query("q_section_fill", f"WITH {SECTION} SELECT code, year, page, section FROM sec")
def section_fill(load):
    return P.sections(load("report_page")).select("code", "year", "page", "section")


@query("q_toc_asof", """WITH b AS (SELECT code, year, page, CASE WHEN contains(title, '管理层讨论与分析') THEN 'management' WHEN contains(title, '公司治理') THEN 'gov' WHEN contains(title, '财务报告') THEN 'fuzhu' WHEN contains(title, '备查文件') THEN 'other' END AS mark FROM outline WHERE level = 1)
SELECT p.code, p.year, p.page, coalesce(b.mark, 'other') AS section FROM report_page p ASOF LEFT JOIN (SELECT * FROM b WHERE mark IS NOT NULL) b ON p.code = b.code AND p.year = b.year AND p.page >= b.page""")
def toc_asof(load):
    return P.sections_by_outline(load("report_page"), load("outline"))


@query("q_toc_pages", "SELECT code, year, page FROM report_page WHERE len(regexp_extract_all(text, '[.·。．…]{4,}')) >= 3")
def toc_pages(load):
    return load("report_page").where(T.is_contents_page(F.col("text"))).select("code", "year", "page")


_COUNT = lambda w: f"CAST(sum((length(text) - length(replace(text, '{w}', ''))) / {len(w)}) AS BIGINT)"
TYPES = "ty AS (SELECT code, year, CASE " + " ".join("WHEN " + " AND ".join(f"{_COUNT(w)} >= {n}" for w, n in marks) + f" THEN '{kind}'" for kind, marks in P.DOC_TYPES.items()) + " ELSE 'normal' END AS doc_type FROM report_page GROUP BY code, year)"


@query("q_doc_type", f"WITH {TYPES} SELECT doc_type, count(*) AS n FROM ty GROUP BY ALL")
def doc_type(load):
    return P.doc_types(load("report_page")).groupBy("doc_type").agg(F.count("*").alias("n"))


_FIRST = ", ".join(f"min(page) FILTER (regexp_matches(text, '{'|'.join(w)}')) AS {g}" for g, w in P.GROUPS.items())
_PARTS = ", ".join(f"CASE WHEN {g} IS NOT NULL THEN '{g}:' || CAST(CAST(floor({g} * 10 / n_pages) AS BIGINT) AS VARCHAR) END" for g in sorted(P.GROUPS))
PRINTS = f"{TYPES}, fg AS (SELECT code, year, max(page) AS n_pages, {_FIRST} FROM report_page GROUP BY ALL), pr AS (SELECT code, year, doc_type, n_pages, doc_type || '|' || array_to_string(list_filter([{_PARTS}], lambda x: x IS NOT NULL), ',') AS signature FROM fg JOIN ty USING (code, year)), fpr AS (SELECT *, substr(md5(signature), 1, 12) AS hash FROM pr)"


@query("q_fingerprint", f"WITH {PRINTS} SELECT * FROM fpr")
def fingerprint(load):
    return P.fingerprints(load("report_page"))


@query("q_fp_survey", f"WITH {PRINTS}, c AS (SELECT hash, count(*) AS size, min(signature) AS signature FROM fpr GROUP BY ALL) SELECT hash, size, signature, size = 1 AS singleton FROM c ORDER BY size DESC, hash LIMIT 15")
def fp_survey(load):
    return P.clusters(P.fingerprints(load("report_page"))).withColumn("singleton", F.col("size") == 1).orderBy(F.desc("size"), "hash").limit(15)


@query("q_amortization", f"""WITH {PRINTS}, c AS (SELECT hash, count(*) AS size FROM fpr GROUP BY ALL), r AS (SELECT *, sum(size) OVER (ORDER BY size DESC, hash) AS cum, row_number() OVER (ORDER BY size DESC, hash) AS i, sum(size) OVER () AS total FROM c)
SELECT level, min(i) AS n_clusters FROM r CROSS JOIN (SELECT unnest([0.5::DOUBLE, 0.8, 0.9, 0.95]) AS level) l WHERE cum >= level * total GROUP BY level""")
def amortization(load):
    return P.amortization(P.clusters(P.fingerprints(load("report_page"))))


@query("q_can_handle", f"SELECT code, year, CASE WHEN {_COUNT('非利息净收入')} >= 2 THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM report_page WHERE page <= 80 GROUP BY ALL")
def can_handle(load):
    return P.bank_score(load("report_page"))


@query("q_locate_pages", """WITH n AS (SELECT code, year, max(page) AS m FROM report_page GROUP BY ALL), h AS (SELECT code, year, page FROM report_page WHERE regexp_matches(text, '前五名客户|前五名供应商')),
w AS (SELECT DISTINCT h.code, h.year, h.page + d.d AS page FROM h JOIN n USING (code, year) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS d) d WHERE h.page + d.d BETWEEN 1 AND n.m)
SELECT * FROM w UNION ALL SELECT code, year, p.p FROM n CROSS JOIN (SELECT unnest([2, 3, 4]) AS p) p WHERE p.p <= n.m AND NOT EXISTS (SELECT 1 FROM h WHERE h.code = n.code AND h.year = n.year)""")
def locate_pages(load):
    return P.located(load("report_page"), ("前五名客户", "前五名供应商"))


@query("q_bank_pages", """WITH n AS (SELECT code, year, max(page) AS m FROM report_page GROUP BY ALL), h AS (SELECT code, year, page FROM report_page WHERE contains(text, '利息净收入')),
w AS (SELECT DISTINCT h.code, h.year, h.page + d.d AS page FROM h JOIN n USING (code, year) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS d) d WHERE h.page + d.d BETWEEN 16 AND n.m)
SELECT code, year, page FROM (SELECT *, row_number() OVER (PARTITION BY code, year ORDER BY page) AS rn FROM w) r WHERE rn <= 15""")
def bank_pages(load):
    """Candidate pages of bank reports: keyword pages and neighbours from page 16 on, the first 15."""
    p = P.located(load("report_page").where("k = 2"), ("利息净收入",), fallback=(1, 1)).where("page >= 16")
    return p.withColumn("rn", F.row_number().over(Window.partitionBy("code", "year").orderBy("page"))).where("rn <= 15").drop("rn")


@query("q_rank_pages", f"""WITH {SECTION}, s AS (SELECT code, year, page, section, 10 * (CAST(contains(text, '营业收入构成') AS INT) + CAST(contains(text, '分产品') AS INT)) + CAST(contains(text, '营业收入') AS INT) + CAST(contains(text, '研发') AS INT) AS h FROM sec),
t AS (SELECT code, year, page, h + CASE WHEN section = 'management' THEN 5 ELSE 0 END AS score FROM s WHERE h > 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY code, year ORDER BY score DESC, page) AS INT) AS rank FROM t) SELECT * FROM r WHERE rank <= 3""")
def rank_pages(load):
    return P.ranked(load("report_page"), ("营业收入构成", "分产品"), ("营业收入", "研发"))


@query("q_snippet", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), p AS (SELECT doc_id, x, list_position(list_transform(x, lambda y: contains(y, 'the')), true) AS at_line FROM l)
SELECT doc_id, CAST(at_line AS INT) AS at, array_to_string(x[greatest(at_line - 2, 1):at_line + 3], chr(10)) AS snippet FROM p WHERE at_line > 0""".replace(" AS at,", ' AS "at",'))
def snippet(load):
    return P.snippets(load("documents"), "the")


@query("q_near_numbers", r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), p AS (SELECT doc_id, x, list_position(list_transform(x, lambda y: contains(lower(y), 'license')), true) AS i FROM l)
SELECT doc_id, array_to_string(list_filter(regexp_extract_all(array_to_string(x[greatest(i - 1, 1):i + 4], ' '), '[0-9]+(?:[.][0-9]+)?'), lambda v: CAST(v AS DOUBLE) > 10), ',') AS numbers FROM p WHERE i > 0""")
def near_numbers(load):
    """Numbers over 10 from the line before to four lines after the first line with a keyword."""
    lines = F.split("text", "\n")
    at = F.array_position(F.transform(lines, lambda x: F.lower(x).contains("license")), True).cast("int")
    d = load("documents").select("doc_id", lines.alias("x"), at.alias("i")).where("i > 0").withColumn("s", F.greatest(F.col("i") - 1, F.lit(1)))
    near = F.array_join(F.slice("x", F.col("s"), F.col("i") + 4 - F.col("s") + 1), " ")
    return d.select("doc_id", F.array_join(F.filter(F.regexp_extract_all(near, F.lit("[0-9]+(?:[.][0-9]+)?"), F.lit(0)), lambda v: v.cast("double") > 10), ",").alias("numbers"))


VIEWS["spots"] = "SELECT code, year, table_id, page, top, bottom, cols, tie, tie2 FROM placed"
_FOLLOW = "b.code = a.code AND b.year = a.year AND b.cols BETWEEN a.cols - 2 AND a.cols + 2 AND ((b.page = a.page AND b.top - a.bottom BETWEEN 0 AND 180) OR (b.page = a.page + 1 AND b.top <= 150))"


@query("q_following", f"""WITH j AS (SELECT a.code, a.year, a.table_id, a.page AS p0, a.top AS t0, b.table_id AS next_id, row_number() OVER (PARTITION BY a.code, a.year, a.table_id, a.page, a.top ORDER BY b.page, b.top, b.table_id) AS rn FROM spots a JOIN spots b ON {_FOLLOW})
SELECT code, year, table_id, p0, t0, next_id, CAST(rn AS INT) AS rn FROM j WHERE rn <= 2""")
def following(load):
    """The two tables that may go on from each table: a band self-join within a report, on equal keys."""
    a = load("spots").select("code", "year", "table_id", F.col("page").alias("p0"), F.col("top").alias("t0"), "bottom", "cols")
    b = load("spots").select("code", "year", F.col("table_id").alias("next_id"), F.col("page").alias("p1"), F.col("top").alias("t1"), F.col("cols").alias("cols1"))
    near = ((F.col("p1") == F.col("p0")) & (F.col("t1") - F.col("bottom")).between(0, 180)) | ((F.col("p1") == F.col("p0") + 1) & (F.col("t1") <= 150))
    j = a.join(b, ["code", "year"]).where(near & (F.abs(F.col("cols1") - F.col("cols")) <= 2))
    w = Window.partitionBy("code", "year", "table_id", "p0", "t0").orderBy("p1", "t1", "next_id")
    return j.withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("code", "year", "table_id", "p0", "t0", "next_id", "rn")


@query("q_neighbors", "SELECT code, year, table_id, page, lead(table_id) OVER w AS next_id, lead(page) OVER w AS next_page FROM spots WINDOW w AS (PARTITION BY code, year ORDER BY page, top, table_id)")
def neighbors(load):
    w = Window.partitionBy("code", "year").orderBy("page", "top", "table_id")
    return load("spots").select("code", "year", "table_id", "page", F.lead("table_id").over(w).alias("next_id"), F.lead("page").over(w).alias("next_page"))


VIEWS["prov"] = "SELECT code, year, CAST(row_number() OVER (PARTITION BY code, year ORDER BY page, top, table_id) AS INT) AS item, page, top + 10 AS y0, top + 20 AS y1 FROM spots WHERE cols = 2"
_VOTE = "CASE WHEN p.y0 < t.bottom + 3 AND p.y1 > t.top - 3 THEN CASE WHEN p.y0 >= t.top AND p.y1 <= t.bottom - 30 THEN 3 ELSE 2 END ELSE 1 END"


@query("q_prov_vote", f"""WITH v AS (SELECT t.code, t.year, t.table_id, t.top, p.item, max({_VOTE}) AS v FROM spots t JOIN prov p USING (code, year, page) GROUP BY ALL), s AS (SELECT code, year, table_id, top, sum(v) AS votes FROM v GROUP BY ALL)
SELECT code, year, arg_max(table_id, (votes, -table_id, -top)) AS table_id, CAST(max(votes) AS BIGINT) AS votes FROM s GROUP BY ALL""")
def prov_vote(load):
    """Which table provenance points to: each item votes 3 for a table with its cell, 2 for an overlapping one, 1 for one on its page."""
    over = (F.col("y0") < F.col("bottom") + 3) & (F.col("y1") > F.col("top") - 3)
    inside = (F.col("y0") >= F.col("top")) & (F.col("y1") <= F.col("bottom") - 30)
    j = load("spots").join(load("prov"), ["code", "year", "page"])
    v = j.groupBy("code", "year", "table_id", "top", "item").agg(F.max(F.when(over & inside, 3).when(over, 2).otherwise(1)).alias("v"))
    s = v.groupBy("code", "year", "table_id", "top").agg(F.sum("v").alias("votes"))
    return s.groupBy("code", "year").agg(F.max_by("table_id", F.struct("votes", -F.col("table_id"), -F.col("top"))).alias("table_id"), F.max("votes").alias("votes"))


@query("q_prov_page", "WITH c AS (SELECT code, year, page, count(*) AS n, min(item) AS f FROM prov GROUP BY ALL) SELECT code, year, arg_max(page, (n, -f)) AS page FROM c GROUP BY ALL")
def prov_page(load):
    c = load("prov").groupBy("code", "year", "page").agg(F.count("*").alias("n"), F.min("item").alias("f"))
    return c.groupBy("code", "year").agg(F.max_by("page", F.struct("n", -F.col("f"))).alias("page"))


@query("q_best_source", """WITH n AS (SELECT DISTINCT code, year, '类' || name AS nm FROM pred WHERE dim = 'segments'), h AS (SELECT code, year, table_id, count(DISTINCT r) AS n FROM cells JOIN n ON cells.code = n.code AND cells.year = n.year AND cells.v = n.nm GROUP BY cells.code, cells.year, table_id)
SELECT code, year, arg_max(table_id, (n, -table_id)) AS table_id, max(n) AS n FROM h GROUP BY ALL""".replace("(SELECT code, year, table_id, count", "(SELECT cells.code, cells.year, table_id, count"))
def best_source(load):
    """The table that holds most of the parsed names, by rows with one."""
    names = load("pred").where("dim = 'segments'").select("code", "year", F.concat(F.lit("类"), "name").alias("v")).distinct()
    h = load("cells").join(names, ["code", "year", "v"], "left_semi").groupBy(*G.TABLE).agg(F.count_distinct("r").alias("n"))
    return h.groupBy("code", "year").agg(F.max_by("table_id", F.struct("n", -F.col("table_id"))).alias("table_id"), F.max("n").alias("n"))
