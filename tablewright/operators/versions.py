"""Parsers made for one layout of report, as strategies over all reports at once, and what decides about them.

Each strategy takes cells of all tables, keeps those whose text has its words, finds its columns from counts of each
column, and gives (code, year, table_id, r, dim, name, amount, ratio) of the first table of a report that yields rows. Reports without any
have no rows. Cells that are null are empty; a table's columns and rows travel as one array, which its page bounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.operators.grid import TABLE, grid_rows

#: The words by which each layout's tables are known, and its markers of dimensions.
COST_WORDS = ("占营业成本比重", "占成本比重")
STAFF_LISTS = {"专业构成": "composition", "教育程度": "education"}
STAFF_TOTAL = "在职员工的数量合计"
RND_WORDS = ("本期发生额", "新品开发费", "检测费")
PARTNER_WORDS = {"client": ("客户名称", "占年度销售总额"), "supplier": ("供应商名称", "占年度采购")}
BUCKETS = {"分行业": "industries", "分产品": "segments", "分地区": "regions", "分销售模式": "by_channel"}
TWO_YEARS = BUCKETS | {"分销售渠道": "by_channel"}


def _dealt(df: DataFrame) -> DataFrame:
    """Dealt by report: what a parser groups, joins and ranks by table or report after that shuffles nothing."""
    return df.repartition("code", "year")


def _holding(cells: DataFrame, every: tuple[str, ...] = (), some: tuple[str, ...] = ()) -> DataFrame:
    """Cells of the tables whose whole text has every word of the one list and some word of the other, dealt by report."""
    cells = _dealt(cells.select(*TABLE, "r", "c", "v"))
    parts = F.array_sort(F.collect_list(F.struct("r", "c", F.coalesce("v", F.lit("")).alias("v"))))
    text = cells.groupBy(*TABLE).agg(F.array_join(F.transform(parts, lambda x: x["v"]), "").alias("text"))
    for w in every:
        text = text.where(F.col("text").contains(w))
    if some:
        text = text.where(T.contains_any(F.col("text"), some))
    return cells.join(text.select(*TABLE), list(TABLE), "left_semi")


def _share(v: Column) -> Column:
    return F.when(v.contains("%"), T.parse_ratio(v))


def _layout(cells: DataFrame, big: float, heading: str = "") -> DataFrame:
    """One row for each table: ``cols``, the counts of its columns from left to right."""
    v, inside = F.col("v"), F.when(F.col("_share").between(0, 100), F.col("_share"))
    named = T.is_text(v) & ~F.coalesce(v.contains(heading), F.lit(False)) if heading else T.is_text(v)
    n = cells.withColumn("_share", _share(v)).groupBy(*TABLE, "c").agg(
        F.count(inside).alias("n_share"), F.round(F.sum(inside), 6).alias("shares"), F.count_if(v.contains("%")).alias("n_percent"), F.count_if(T.parse_money(v) > big).alias("n_big"), F.count_if(named).alias("n_text")
    )
    return n.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct("c", "n_share", "shares", "n_percent", "n_big", "n_text"))).alias("cols"))


def _leftmost(test: Callable[[Column], Column]) -> Column:
    return F.get(F.filter("cols", test), F.lit(0))["c"]


def _left_of(column: str, test: Callable[[Column], Column]) -> Column:
    """The nearest column on the left of another one that passes."""
    return F.try_element_at(F.filter("cols", lambda x: (x["c"] < F.col(column)) & test(x)), F.lit(-1))["c"]


def _most(count: str) -> Column:
    """The column with the highest count, the leftmost of equals."""
    return F.get(F.array_sort(F.transform("cols", lambda x: F.struct((-x[count]).alias("n"), x["c"].alias("c")))), F.lit(0))["c"]


def _at(column: str) -> Column:
    return F.coalesce(F.get("row", F.col(column)), F.lit(""))


def _first_text() -> Column:
    return F.coalesce(F.get(F.filter("row", T.is_text), F.lit(0)), F.lit(""))


def _first_table(items: DataFrame, counts: Column | None = None) -> DataFrame:
    """Items of the first table of a report that has any, or any that count."""
    first = F.min(F.col("table_id") if counts is None else F.when(counts, F.col("table_id"))).over(Window.partitionBy("code", "year"))
    return items.withColumn("_first", first).where("table_id = _first").drop("_first")


def _shaped(rows: DataFrame, dim: Column, name: Column, amount: Column, ratio: Column) -> DataFrame:
    return rows.select(*TABLE, "r", dim.alias("dim"), name.alias("name"), amount.cast("double").alias("amount"), ratio.cast("double").alias("ratio"))


def _last_marker(rows: DataFrame, default: str) -> DataFrame:
    """``dim``: the dimension that the last ``marker`` opened, the default before any."""
    before = Window.partitionBy(*TABLE).orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("dim", F.coalesce(F.last("marker", ignorenulls=True).over(before), F.lit(default)))


def _mapped(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def flat_costs(cells: DataFrame) -> DataFrame:
    """A flat list of costs: shares in the leftmost column whose shares add up to 95..105, amounts in the nearest one on its left with two
    values over 1,000, names in the nearest text column before that (else the first)."""
    cells = _holding(cells, some=COST_WORDS)
    cols = _layout(cells, 1000).withColumn("rc", _leftmost(lambda x: (x["n_share"] >= 2) & x["shares"].between(95, 105))).withColumn("mc", _left_of("rc", lambda x: x["n_big"] >= 2))
    cols = cols.where("mc is not null").withColumn("nc", F.coalesce(_left_of("mc", lambda x: x["n_text"] >= 2), F.lit(0)))
    rows = grid_rows(cells).join(cols.select(*TABLE, "rc", "mc", "nc"), list(TABLE))
    items = _shaped(rows, F.lit("costs"), _at("nc"), T.parse_money(_at("mc")), T.parse_ratio(_at("rc")))
    return _first_table(items.where((F.col("name") != "") & F.col("ratio").isNotNull() & ~T.is_total(F.col("name"))))


def staff_lists(cells: DataFrame) -> DataFrame:
    """The two lists of a staff table and its total: a row's name is its first filled cell, its count its first number."""
    rows = grid_rows(_holding(cells, every=tuple(STAFF_LISTS)))
    name = F.coalesce(F.get(F.filter("row", lambda x: x != ""), F.lit(0)), F.lit(""))
    count = F.round(F.get(F.filter(F.transform("row", T.parse_money), lambda x: x.isNotNull()), F.lit(0)))
    rows = rows.select(*TABLE, "r", name.alias("name"), count.alias("count"), name.contains(STAFF_TOTAL).alias("total"))
    opens = None
    for word, kind in STAFF_LISTS.items():
        test = ~F.col("total") & F.col("name").contains(word)
        opens = F.when(test, kind) if opens is None else opens.when(test, kind)
    rows = _last_marker(rows.withColumn("marker", opens), "")
    listed = F.col("marker").isNull() & (F.col("dim") != "") & (F.col("name") != "") & ~T.is_total(F.col("name"))
    rows = rows.where(F.col("count").isNotNull() & (F.col("total") | listed)).withColumn("dim", F.when(F.col("total"), "total").otherwise(F.col("dim")))
    return _first_table(_shaped(rows, F.col("dim"), F.col("name"), F.col("count"), F.lit(None)), F.col("dim") != "total")


def rnd_details(cells: DataFrame, sections: DataFrame) -> DataFrame:
    """R&D accounts among the notes (section fuzhu): this and last amount are the first two columns with three values over 1,000; here ``ratio``
    is the last amount. The first table whose details add up to its total counts, else the first with details; of its total rows the last."""
    notes = _dealt(sections.where("section = 'fuzhu'").select(*TABLE))
    cells = _holding(cells, every=RND_WORDS).join(notes, list(TABLE), "left_semi")
    wide = F.filter("cols", lambda x: x["n_big"] >= 3)
    cols = _layout(cells, 1000).select(*TABLE, F.get(wide, F.lit(0))["c"].alias("ac"), F.get(wide, F.lit(1))["c"].alias("lc")).where("ac is not null")
    rows = grid_rows(cells).join(cols, list(TABLE)).withColumn("name", _first_text())
    total = F.col("name").contains("合计") | T.is_total(F.col("name"))
    items = _shaped(rows, F.when(total, "total").otherwise("detail"), F.col("name"), T.parse_money(_at("ac")), T.parse_money(_at("lc"))).where((F.col("name") != "") & (F.col("name") != "项目") & F.col("amount").isNotNull())
    detail = F.when(F.col("dim") == "detail", F.col("amount"))
    sums = items.groupBy(*TABLE).agg(F.count(detail).alias("n"), F.sum(detail).alias("s"), F.max_by("amount", F.when(F.col("dim") == "total", F.col("r"))).alias("t"), F.max(F.when(F.col("dim") == "total", F.col("r"))).alias("total_r")).where("n > 0")
    agrees = F.coalesce((F.col("t") != 0) & (F.abs(F.col("s") - F.col("t")) <= F.greatest(F.lit(1.0), F.col("t") * 1e-4)), F.lit(False))
    best = sums.groupBy("code", "year").agg(F.min(F.struct((~agrees).alias("off"), "table_id", "total_r")).alias("b")).select("code", "year", "b.table_id", "b.total_r")
    return items.join(best, list(TABLE)).where((F.col("dim") == "detail") | (F.col("r") == F.col("total_r"))).drop("total_r")


def partners(cells: DataFrame, kind: str) -> DataFrame:
    """Clients or suppliers by majority: shares in the column with most percent signs, amounts in that with most values over 10,000, names in that with
    most text. A row without a share is none; one with 合计 or 小计 is a total, of which the last stays."""
    heading = PARTNER_WORDS[kind][0]
    cells = _holding(cells, every=PARTNER_WORDS[kind])
    cols = _layout(cells, 10000, heading).select(*TABLE, _most("n_percent").alias("rc"), _most("n_big").alias("mc"), _most("n_text").alias("nc"))
    rows = grid_rows(cells).join(cols, list(TABLE))
    total = F.array_join("row", "").rlike("合计|小计")
    items = _shaped(rows, F.when(total, "total").otherwise(kind), F.when(total, "").otherwise(_at("nc")), T.parse_money(_at("mc")), _share(_at("rc"))).where("ratio is not null")
    items = items.where((F.col("dim") == "total") | ((F.col("name") != "") & ~F.col("name").contains(heading)))
    last = F.max(F.when(F.col("dim") == "total", F.col("r"))).over(Window.partitionBy(*TABLE))
    items = items.withColumn("_last", last).where((F.col("dim") != "total") | (F.col("r") == F.col("_last"))).drop("_last")
    return _first_table(items, F.col("dim") != "total")


def buckets(cells: DataFrame) -> DataFrame:
    """Revenue by marked dimensions, safe from margin tables: shares in the leftmost column, but the first, whose shares in the dimension with
    most rows add up to 95..105, amounts in the nearest column on its left with two values over 1,000."""
    rows = grid_rows(_holding(cells, some=("分产品", "分地区"))).withColumn("key", F.replace(F.col("row")[0], F.lit(" "), F.lit("")))
    rows = _last_marker(rows.withColumn("marker", F.try_element_at(_mapped(BUCKETS), F.col("key"))), "industries")
    shares = F.exists(F.slice("row", 2, F.size("row")), lambda x: F.coalesce(_share(x).between(0, 100), F.lit(False)))
    rows = rows.where(F.col("marker").isNull() & (F.col("key") != "") & ~T.is_total(F.col("key")) & shares)
    cell = rows.select(*TABLE, "r", "dim", F.posexplode("row").alias("c", "v"))
    inside = F.when(_share(F.col("v")).between(0, 100), _share(F.col("v")))
    n = cell.groupBy(*TABLE, "dim", "c").agg(F.count("*").alias("n"), F.min("r").alias("from"), F.count(inside).alias("n_share"), F.round(F.sum(inside), 6).alias("shares"), F.count_if(T.parse_money(F.col("v")) > 1000).alias("n_big"))
    t = n.groupBy(*TABLE).agg(F.min_by("dim", F.when(F.col("c") == 0, F.struct(-F.col("n"), "from"))).alias("top"), F.array_sort(F.collect_list(F.struct("c", "dim", "n_share", "shares", "n_big"))).alias("cols"))
    t = t.withColumn("rc", _leftmost(lambda x: (x["dim"] == F.col("top")) & (x["c"] >= 1) & (x["n_share"] >= 2) & x["shares"].between(95, 105))).where("rc is not null")
    hits = lambda c: F.aggregate(F.filter("cols", lambda x: x["c"] == c), F.lit(0).cast("bigint"), lambda a, x: a + x["n_big"])
    t = t.withColumn("mc", F.try_element_at(F.filter(F.sequence(F.lit(0), F.col("rc") - 1), lambda c: hits(c) >= 2), F.lit(-1)))
    items = _shaped(rows.join(t.select(*TABLE, "rc", "mc"), list(TABLE)), F.col("dim"), F.col("row")[0], T.parse_money(_at("mc")), T.parse_ratio(_at("rc")))
    return _first_table(items.where("ratio is not null"), F.col("dim").isin("segments", "industries"))


def two_years(cells: DataFrame) -> DataFrame:
    """Revenue of two years side by side: shares in the leftmost column with two of 0..100 (this year stands left), amounts in the nearest column on
    its left with two values over 10,000; a row's name is its first text, of 30 characters at most."""
    cells = _holding(cells, every=("%",), some=("分产品", "分行业", "分地区"))
    cols = _layout(cells, 10000).withColumn("rc", _leftmost(lambda x: x["n_share"] >= 2)).withColumn("mc", _left_of("rc", lambda x: x["n_big"] >= 2)).where("mc is not null")
    marker = F.get(F.filter(F.transform("row", lambda x: F.try_element_at(_mapped(TWO_YEARS), x)), lambda x: x.isNotNull()), F.lit(0))
    rows = _last_marker(grid_rows(cells).withColumn("marker", marker), "segments").where("marker is null").join(cols.select(*TABLE, "rc", "mc"), list(TABLE))
    full = _first_text()
    items = _shaped(rows.where((full != "") & ~T.is_total(full)), F.col("dim"), F.substring(full, 1, 30), T.parse_money(_at("mc")), _share(_at("rc")))
    items = items.where("ratio is not null or amount is not null").withColumn("ratio", F.when(F.col("ratio").between(0, 100), F.col("ratio")))
    return _first_table(items)


def continued(tables: DataFrame) -> DataFrame:
    """Chains of tables that go on: a table joins the chain before it if it stands on the page of the chain's head or the next one and
    its width is within two of the chain's. ``tables`` has code, year, table_id, page, width and repeats (its first row repeats a marker of
    dimensions); out: chain, from 1, and cut, whether its first row goes. One fold over the tables of a report in order of page, then id."""
    listed = tables.groupBy("code", "year").agg(F.array_sort(F.collect_list(F.struct("page", "table_id", "width", "repeats"))).alias("t"))
    state = "struct<page:int,width:int,chain:int,out:array<struct<table_id:bigint,chain:int,cut:boolean>>>"
    start = F.expr(f"cast(named_struct('page', null, 'width', 0, 'chain', 0, 'out', array()) as {state})")

    def step(a, x):
        on = F.coalesce(x["page"].isin(a["page"], a["page"] + 1) & (F.abs(a["width"] - x["width"]) <= 2), F.lit(False))
        chain = (a["chain"] + F.when(on, 0).otherwise(1)).cast("int")
        item = F.struct(x["table_id"].cast("bigint").alias("table_id"), chain.alias("chain"), (on & x["repeats"]).alias("cut"))
        return F.struct(F.when(on, a["page"]).otherwise(x["page"]).alias("page"), F.when(on, F.greatest(a["width"], x["width"])).otherwise(x["width"]).alias("width"), chain.alias("chain"), F.array_append(a["out"], item).alias("out"))

    return listed.select("code", "year", F.explode(F.aggregate("t", start, step, lambda a: a["out"])).alias("x")).select("code", "year", "x.*")


def page_merged(cells: DataFrame, pages: DataFrame) -> DataFrame:
    """The further candidate of a page with several tables: all their rows in order, padded to the widest: code, year, page, r, row."""
    page = Window.partitionBy("code", "year", "page")
    at = F.map_from_entries(F.collect_list(F.struct("c", F.coalesce(T.strip(F.col("v")), F.lit("")).alias("v"))))
    rows = cells.join(pages.select(*TABLE, "page"), list(TABLE)).groupBy(*TABLE, "page", "r").agg(at.alias("at"), (F.max("c") + 1).alias("w"))
    rows = rows.select("*", F.max("w").over(page).alias("width"), (F.row_number().over(page.orderBy("table_id", "r")) - 1).alias("to"), F.min("table_id").over(page).alias("a"), F.max("table_id").over(page).alias("b")).where("a < b")
    return rows.select("code", "year", "page", F.col("to").alias("r"), F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(""))).alias("row"))


def extraction_heal(items: DataFrame, anchors: DataFrame, saved: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """The first extraction profile whose items the anchor confirms. ``items`` has code, year, profile, ord, dim, amount of each trial, ``saved`` the profile
    kept for a report, which is tried first. Out: outcome (fixed, still_bad), profile, n_tries."""
    s = items.groupBy("code", "year", "profile", "ord", "dim").agg(F.sum("amount").cast("double").alias("s")).where("s <> 0").join(anchors.select("code", "year", F.col("revenue").cast("double").alias("a")), ["code", "year"], "left")
    ok = F.bool_and(F.coalesce((F.col("a") > 0) & (F.abs(F.col("s") - F.col("a")) <= tolerance * F.col("a")), F.lit(False)))
    t = s.groupBy("code", "year", "profile", "ord").agg(ok.alias("ok")).join(saved.select("code", "year", F.col("profile").alias("kept")), ["code", "year"], "left")
    t = t.withColumn("n", F.row_number().over(Window.partitionBy("code", "year").orderBy(~F.col("profile").eqNullSafe(F.col("kept")), "ord")))
    hit = F.when(F.col("ok"), F.col("n"))
    return t.groupBy("code", "year").agg(F.when(F.count(hit) > 0, "fixed").otherwise("still_bad").alias("outcome"), F.min_by("profile", hit).alias("profile"), F.coalesce(F.min(hit), F.max("n")).alias("n_tries"))


def certifiable(reports: DataFrame, scores: DataFrame) -> DataFrame:
    """What a rewritten parser's score on each report (code, year, score, exact) allows: only an exact one is certified."""
    j = reports.select("code", "year").join(scores.select("code", "year", "score", "exact"), ["code", "year"], "left")
    return j.select("code", "year", "score", F.when(F.col("score").isNull(), "no_golden").when(F.col("exact"), "certified").otherwise("not_exact").alias("status"))
