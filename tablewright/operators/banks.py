"""The bank path: reports of banks have one flat breakdown, in a table of their own layout.

Pages, tables and cells are keyed by (code, year). A report's pages are narrowed to a few, its tables on them are
scored by words, the best one's columns are found by what their cells are, and its rows become unique names. All of it is
conditional aggregates over long cells, so no table or page is gathered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.operators.grid import TABLE

REPORT = ("code", "year")
#: What a page with the breakdown says, and what two words do together where none says that.
PAGE_WORDS = ("营业收入构成", "项目 2025年 2024年", "利息净收入 非利息净收入")
PAGE_PAIR = ("营业收入", "利息净收入")
#: No breakdown stands before this page, and no more pages than this are read.
FIRST_PAGE, MOST_PAGES = 16, 15
#: Words that a table needs one of, and the weights of words (any of the first, all of the second kind).
NEEDED = ("营业收入", "收入构成")
ANY_WEIGHTS = ((("利息净收入",), 40), (("非利息净收入",), 30), (("同比", "增减"), 10), (("占比", "%"), 10), (("研发",), -20))
ALL_WEIGHTS = ((("员工", "人数"), -30), (("总负债", "总资产"), -30))
LEAST_SCORE = 40
#: Words of headings that are years or amounts when a digit stands beside them.
HEADING_WORDS = ("年", "金额", "占比", "增减")


def candidate_pages(pages: DataFrame) -> DataFrame:
    """code, year, page: pages with one of the words and their neighbours or, where a report has none, the first page with both
    words of the pair and its neighbours; from page 16 on, the first 15. A page without text has no words."""
    has = lambda words: T.contains_any(F.col("text"), words)
    pair = has(PAGE_PAIR[:1]) & has(PAGE_PAIR[1:])
    n = pages.groupBy(*REPORT).agg(F.max("page").alias("last"), F.collect_set(F.when(has(PAGE_WORDS), F.col("page"))).alias("hits"), F.min(F.when(pair, F.col("page"))).alias("first"))
    hits = F.when(F.size("hits") > 0, F.col("hits")).otherwise(F.array_compact(F.array("first")))
    near = F.flatten(F.transform(hits, lambda p: F.sequence(p - 1, F.least(p + 1, F.col("last")))))
    kept = F.slice(F.array_sort(F.array_distinct(F.filter(near, lambda p: p >= FIRST_PAGE))), 1, MOST_PAGES)
    return n.select(*REPORT, F.explode(kept).alias("page"))


def table_scores(cells: DataFrame) -> DataFrame:
    """TABLE and score of the tables that have one of the needed words and reach the least score."""
    words = sorted({w for ws, _ in ANY_WEIGHTS + ALL_WEIGHTS for w in ws} | set(NEEDED))
    seen = {w: f"_w{k}" for k, w in enumerate(words)}
    t = cells.groupBy(*TABLE).agg((F.max("r") + 1).alias("n_rows"), *(F.bool_or(F.coalesce(F.col("v").contains(w), F.lit(False))).alias(n) for w, n in seen.items()))

    def joined(ws: tuple[str, ...], every: bool) -> Column:
        out = F.col(seen[ws[0]])
        for w in ws[1:]:
            out = out & F.col(seen[w]) if every else out | F.col(seen[w])
        return out

    score = F.when(F.col("n_rows").between(5, 40), 10).when(F.col("n_rows") > 40, -10).otherwise(0)
    for every, weights in ((False, ANY_WEIGHTS), (True, ALL_WEIGHTS)):
        for ws, n in weights:
            score = score + F.when(joined(ws, every), n).otherwise(0)
    return t.where(joined(NEEDED, False)).select(*TABLE, score.alias("score")).where(F.col("score") >= LEAST_SCORE)


def columns_of(cells: DataFrame) -> DataFrame:
    """name_col, amount_col and ratio_col of each table, null where there is none. Share: the first column with three shares between
    0 and 100. Amount: the first with three numbers; if that is the share column (or there is neither), the first other one
    with two. Name: the first column left with three texts, else the one left with most, else the one with most."""
    v = F.col("v")
    share = v.contains("%") & T.parse_ratio(v).between(0, 100)
    text = T.is_text(v)
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    c = cells.groupBy(*TABLE, "c").agg(n(share).alias("shares"), n(T.is_money(v)).alias("numbers"), n(text).alias("texts"), n(text & ~v.contains("%")).alias("plain"))
    s = c.groupBy(*TABLE).agg(
        F.min(F.when(F.col("shares") >= 3, F.col("c"))).alias("ratio_col"),
        F.min(F.when(F.col("numbers") >= 3, F.col("c"))).alias("_first"),
        F.array_sort(F.collect_list(F.struct("c", "numbers", "texts", (-F.col("plain")).alias("few")))).alias("_cols"),
    )
    first = lambda test: F.get(F.filter("_cols", test), F.lit(0))["c"]
    most = lambda cols: F.array_min(F.transform(cols, lambda x: F.struct(x["few"].alias("few"), x["c"].alias("c"))))["c"]
    other = first(lambda x: (x["numbers"] >= 2) & ~x["c"].eqNullSafe(F.col("ratio_col")))
    s = s.withColumn("amount_col", F.when(F.col("_first").eqNullSafe(F.col("ratio_col")), other).otherwise(F.col("_first")))
    free = lambda x: ~x["c"].eqNullSafe(F.col("amount_col")) & ~x["c"].eqNullSafe(F.col("ratio_col"))
    name = F.coalesce(first(lambda x: free(x) & (x["texts"] >= 3)), most(F.filter("_cols", free)), most(F.col("_cols")))
    return s.select(*TABLE, name.alias("name_col"), "amount_col", "ratio_col")


def page_units(pages: DataFrame, found: DataFrame) -> DataFrame:
    """code, year, unit: the first factor other than 1 that is announced on pages 1 to 10, on the ``found`` pages (code, year, page)
    or beside them, in page order; reports without one are absent."""
    near = found.select(*REPORT, F.explode(F.sequence(F.col("page") - 1, F.col("page") + 1)).alias("page")).distinct()
    told = pages.select(*REPORT, "page", T.bank_unit(F.col("text")).alias("unit")).where("unit <> 1")
    read = told.join(near.withColumn("_near", F.lit(True)), [*REPORT, "page"], "left").where("page between 1 and 10 or _near")
    return read.groupBy(*REPORT).agg(F.min_by("unit", "page").alias("unit"))


def segments(cells: DataFrame) -> DataFrame:
    """TABLE, r, name, amount, ratio (as printed, before units) of each table's rows.

    A name of less than two characters gives way to the row's first text of two or more. Headings, totals and years
    are left out, rows without number and share too. A share that stands in the amount's place is read as share; one
    outside 0 to 100 is null, its row stays. Of equal names the first stays. Null cells are empty."""
    v = T.strip(F.coalesce("v", F.lit("")))
    at = lambda col: F.coalesce(F.max(F.when(F.col("c") == F.col(col), F.col("v"))), F.lit(""))
    placed = cells.select(*TABLE, "r", "c", v.alias("v")).join(columns_of(cells), list(TABLE))
    named = T.is_text(F.col("v")) & (F.length("v") >= 2)
    rows = placed.groupBy(*TABLE, "r").agg(at("name_col").alias("own"), at("amount_col").alias("a"), at("ratio_col").alias("q"), F.min_by("v", F.when(named, F.col("c"))).alias("spare"))
    rows = rows.withColumn("raw", F.when(F.length("own") >= 2, F.col("own")).otherwise(F.substring("spare", 1, 30)))
    heading = F.col("raw").isin("项 目", "项目") | T.is_total(F.col("raw")) | (F.col("raw").rlike("|".join(HEADING_WORDS)) & F.col("raw").rlike("[0-9０-９]"))
    share = F.coalesce(T.parse_ratio(F.col("q")), F.when(F.col("a").contains("%"), T.parse_ratio(F.col("a"))))
    rows = rows.where(F.col("raw").isNotNull() & ~heading).select(*TABLE, "r", "raw", T.parse_money(F.col("a")).alias("amount"), share.alias("ratio")).where("amount is not null or ratio is not null")
    one = rows.groupBy(*TABLE, "raw").agg(F.min_by(F.struct("r", "amount", "ratio"), "r").alias("x"))
    name = F.substring(T.strip(F.get(F.split("raw", "  "), F.lit(0))), 1, 30)
    return one.select(*TABLE, "x.r", name.alias("name"), F.when(F.col("x.amount") != 0, F.col("x.amount")).alias("amount"), F.when(F.col("x.ratio").between(0, 100), F.col("x.ratio")).alias("ratio"))


def parse(reports: DataFrame, pages: DataFrame, cells: DataFrame, meta: DataFrame) -> DataFrame:
    """A row for each item, and one without an item for a report that has none: code, year, status, table_id, unit, idx, name,
    amount (in yuan), ratio. ``pages``: code, year, page, text; ``meta``: TABLE, page. Of equal scores the table on the first page, then
    the first table. status is no_table_found where no page or no table qualifies."""
    found = candidate_pages(pages)
    on_page = meta.select(*TABLE, "page").join(found, [*REPORT, "page"])
    here = cells.select(*TABLE, "r", "c", "v").join(on_page, list(TABLE))
    scored = table_scores(here).join(on_page, list(TABLE))
    best = scored.groupBy(*REPORT).agg(F.min_by("table_id", F.struct(-F.col("score"), "page", "table_id")).alias("table_id"))
    items = segments(here.join(best, list(TABLE), "left_semi")).join(page_units(pages, found), list(REPORT), "left")
    items = items.withColumn("idx", F.row_number().over(Window.partitionBy(*REPORT).orderBy("r")) - 1)
    items = items.select(*REPORT, F.coalesce("unit", F.lit(1)).alias("unit"), "idx", "name", "amount", "ratio").withColumn("amount", T.to_yuan(F.col("amount"), F.col("unit")))
    out = reports.select(*REPORT).join(best, list(REPORT), "left").join(items, list(REPORT), "left")
    return out.select(*REPORT, F.when(F.col("table_id").isNull(), "no_table_found").otherwise("ok").alias("status"), "table_id", "unit", "idx", "name", "amount", "ratio")
