"""Field parsers on grids: cost items, R&D items, staff, five largest clients and suppliers, and where their values came from.

Each parser takes cells (code, year, table_id, r, c, v) of the tables chosen for its field and reads every
row by expressions over the row's cells; only states that pass from row to row are windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.operators.grid import TABLE, column_types, grid_rows

#: What the parsers' tables, headers and totals are called.
COST_MARKERS = ("占营业成本比重", "营业成本构成")
COST_HEADS = ("项目", "金额", "同比增", "减")
STAFF_TOTAL, STAFF_PARENT = "在职员工的数量合计", "母公司在职员工"
STAFF_MODES = {"专业构成": "composition", "教育程度": "education"}
TOP_FIVE = {
    "client": {"detail": ("客户名称", "销售额"), "summary": "前五名客户合计", "amount": "前五名客户合计销售金额", "ratio": "占年度销售总额比例", "related": ("关联方",)},
    "supplier": {"detail": ("供应商名称", "采购额"), "summary": "前五名供应商合计", "amount": "前五名供应商合计采购金额", "ratio": "占年度采购总额比例", "related": ("关联", "比例")},
}


def _numbers(row: Column, percent: bool) -> Column:
    """Numbers of the cells with or without a percent sign, in order."""
    kind = F.filter(row, lambda x: x.contains("%") if percent else ~x.contains("%"))
    return F.filter(F.transform(kind, lambda x: T.parse_money(F.replace(x, F.lit("%"), F.lit("")))), lambda x: x.isNotNull())


def cost_items(cells: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """industry, item, amounts in yuan and shares of this and last period, and the change, of each row of cost tables. First column
    industry, second item; plain numbers of a row are this and last amount in turn (0 counts as none), percentages this and
    last share, the last of any more the change. ``units`` (TABLE, unit) has factors to yuan, 1 without."""
    rows = grid_rows(cells).where(F.size("row") >= 3)
    industry, item = F.col("row")[0], F.col("row")[1]
    rows = rows.where((item != "") & ~item.isin(*COST_HEADS) & (industry != "") & (industry != "行业分类"))
    rows = rows.join(units, list(TABLE), "left") if units is not None else rows.withColumn("unit", F.lit(1))
    rows = rows.select(*TABLE, "r", industry.alias("industry"), item.alias("item"), F.coalesce("unit", F.lit(1)).alias("unit"), _numbers(F.col("row"), False).alias("n"), _numbers(F.col("row"), True).alias("p"))
    yuan = lambda i: T.to_yuan(F.nullif(F.get("n", F.lit(i)), F.lit(0.0)), F.col("unit"))
    change = F.when(F.size("p") > 2, F.element_at("p", -1))
    return rows.select(*TABLE, "r", "industry", "item", yuan(0).alias("amount_yuan"), F.get("p", F.lit(0)).alias("ratio_pct"), yuan(1).alias("amount_last_yuan"), F.get("p", F.lit(1)).alias("ratio_last_pct"), change.alias("yoy_change_pp"))


def cost_table(ranked: DataFrame, texts: DataFrame) -> DataFrame:
    """Without history: of a report's ranked cost tables the first whose text holds a marker of cost tables, else the first."""
    t = ranked.join(texts.select(*TABLE, "text"), list(TABLE))
    marked = T.contains_any(F.col("text"), COST_MARKERS)
    best = t.groupBy("code", "year").agg(F.min(F.struct((~marked).alias("plain"), "rank", "table_id")).alias("b"))
    return best.select("code", "year", "b.table_id", (~F.col("b.plain")).alias("marked"))


def rnd_items(cells: DataFrame) -> DataFrame:
    """name, this and last amount of each row of R&D tables; ``is_total`` marks rows named as the total. This amount stands in the
    amount column; last is the first other number of the row, or the last one after it that is smaller."""
    types = column_types(cells).select(*TABLE, "name_col", "amount_col")
    rows = grid_rows(cells).join(types, list(TABLE))
    rows = rows.select(*TABLE, "r", F.get("row", F.col("name_col")).alias("name"), T.parse_money(F.get("row", F.col("amount_col"))).alias("amount_this"), F.filter("row", lambda x, i: i != F.col("amount_col")).alias("rest"))
    rows = rows.where((F.col("name") != "") & ~F.col("name").isin("项目", "项 目"))
    rest = F.filter(F.transform("rest", T.parse_money), lambda x: x.isNotNull())
    rows = rows.withColumn("rest", rest)
    smaller = F.filter(F.slice("rest", 2, F.greatest(F.size("rest"), F.lit(1))), lambda x: F.abs(x) < F.abs(F.col("amount_this")))
    last = F.when(F.col("amount_this").isNotNull(), F.coalesce(F.try_element_at(smaller, F.lit(-1)), F.get("rest", F.lit(0))))
    return rows.select(*TABLE, "r", "name", "amount_this", last.alias("amount_last"), (F.col("name") == "合计").alias("is_total"))


def rnd_info(cells: DataFrame) -> DataFrame:
    """Of each table: its items, their sum, and the totals that its last total row states."""
    i = rnd_items(cells)
    at = F.when(F.col("is_total"), F.col("r"))
    return i.groupBy(*TABLE).agg(F.count_if(~F.col("is_total")).alias("n_items"), F.sum(F.when(~F.col("is_total"), F.col("amount_this"))).alias("items_this"), F.max_by("amount_this", at).alias("total_this"), F.max_by("amount_last", at).alias("total_last"))


def staff_items(cells: DataFrame) -> DataFrame:
    """kind (total, parent, composition, education), type and count of the rows of staff tables. A row's count is its first whole
    number; a row that is nothing but a heading opens its list; header and total rows of a list don't count."""
    whole = lambda x: F.regexp_extract(T.strip(F.translate(x, ",，", "")), r"^[+-]?[0-9]+$", 0)
    value = F.get(F.filter(F.transform("row", whole), lambda x: x != ""), F.lit(0)).try_cast("bigint")
    rows = grid_rows(cells).select(*TABLE, "r", T.strip(F.array_join("row", " ")).alias("label"), value.alias("n"))
    total, parent = F.col("label").contains(STAFF_TOTAL), F.col("label").contains(STAFF_PARENT)
    opens = None
    for word, mode in STAFF_MODES.items():
        opens = F.when(F.col("label") == word, mode) if opens is None else opens.when(F.col("label") == word, mode)
    rows = rows.withColumn("opens", opens)
    before = Window.partitionBy(*TABLE).orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("mode", F.last("opens", ignorenulls=True).over(before))
    listed = F.col("opens").isNull() & F.col("n").isNotNull() & ~F.col("label").contains("类别") & ~F.col("label").contains("合计")
    kind = F.when(total, "total").when(parent, "parent").when(listed, F.col("mode"))
    return rows.withColumn("kind", kind).where("kind is not null").select(*TABLE, "r", "kind", F.when(F.col("kind").isin(*STAFF_MODES.values()), F.split("label", " ")[0]).alias("type"), "n")


def staff(items: DataFrame) -> DataFrame:
    """A report's staff from all its tables in order: the first total and parent count that isn't 0 (of a table the last row
    counts), and both lists as the last table that has them gives them."""
    w = Window.partitionBy(*TABLE, "kind").orderBy(F.desc("r"))
    counts = items.where("kind in ('total', 'parent')").withColumn("rn", F.row_number().over(w)).where("rn = 1 and n <> 0")
    heads = counts.groupBy("code", "year").agg(*(F.min_by("n", F.when(F.col("kind") == k, F.col("table_id"))).alias(k) for k in ("total", "parent")))
    lists = items.where("kind in ('composition', 'education')").withColumn("of", F.max("table_id").over(Window.partitionBy("code", "year", "kind"))).where("table_id = of")
    sums = lists.groupBy("code", "year").agg(*(e for k in ("composition", "education") for e in (F.count_if(F.col("kind") == k).alias(f"n_{k}"), F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(f"sum_{k}"))))
    return heads.join(sums, ["code", "year"], "full")


def row_texts(cells: DataFrame) -> DataFrame:
    """Rows as text: filled cells, line breaks as spaces, joined by a space."""
    parts = F.array_sort(F.collect_list(F.struct("c", F.replace("v", F.lit("\n"), F.lit(" ")).alias("v"))))
    return cells.where("v <> ''").groupBy(*TABLE, "r").agg(F.array_join(F.transform(parts, lambda x: x["v"]), " ").alias("line"))


def top_rows(lines: DataFrame) -> DataFrame:
    """rank, name, amount and share of the rows that hold a rank from 1 to 5 among their words: the first number over 100,000, the
    first share from 0 to 100, the first word that is no number, rank, share or dash (else the rank's own name)."""
    words = F.filter(F.split(T.strip(F.col("line")), r"\s+"), lambda x: x != "")
    rows = lines.withColumn("w", words)
    ranks = F.filter("w", lambda x: x.rlike("^0*[1-5]$"))
    rows = rows.withColumn("rank", F.get(ranks, F.lit(0)).try_cast("int")).where("rank is not null")
    amount = F.get(F.filter(F.transform("w", T.parse_money), lambda x: x > 100000), F.lit(0))
    share = F.get(F.filter(F.transform(F.filter("w", lambda x: x.contains("%")), lambda x: T.plain_number(F.replace(x, F.lit("%"), F.lit("")))), lambda x: x.between(0, 100)), F.lit(0))
    named = F.filter("w", lambda x: ~x.contains("%") & T.plain_number(F.replace(x, F.lit(","), F.lit(""))).isNull() & ~x.rlike("^第[0-9]+名$") & ~x.isin("--", "-"))
    name = F.coalesce(F.get(named, F.lit(0)), F.concat(F.lit("第"), F.col("rank").cast("string"), F.lit("名")))
    return rows.select(*TABLE, "r", "rank", name.alias("name"), amount.alias("amount"), share.alias("ratio_pct"))


def top_five(cells: DataFrame, kind: str) -> DataFrame:
    """Clients or suppliers of each report: the rows of its first detail table with any, and amount, share and related parties' share
    as the last rows of its summary tables that state them."""
    words = TOP_FIVE[kind]
    lines = row_texts(cells)
    whole = lines.groupBy(*TABLE).agg(*(F.max(F.col("line").contains(w)).alias(f"d{i}") for i, w in enumerate(words["detail"])), F.max(F.col("line").contains(words["summary"])).alias("summary"))
    lines = lines.join(whole, list(TABLE))
    rows = top_rows(lines.where("d0 and d1"))
    first = F.min("table_id").over(Window.partitionBy("code", "year"))
    items = rows.withColumn("f", first).where("table_id = f").groupBy("code", "year").agg(F.count("*").alias("n"), F.sum("amount").alias("items_amount"), F.min_by("name", F.struct("rank", "r")).alias("first_name"))
    line = F.col("line")
    related = line.contains(words["related"][0])
    for w in words["related"][1:]:
        related &= line.contains(w)
    at = lambda test, value: F.max_by(value, F.when(test, F.struct("table_id", "r")))
    number, share = T.first_token(line, False), T.first_token(line, True)
    sums = lines.where("summary").groupBy("code", "year").agg(
        at(line.contains(words["amount"]) & number.isNotNull(), number).alias("total_amount"),
        at(line.contains(words["ratio"]) & ~line.contains("关联"), share).alias("total_ratio_pct"),
        at(related, share).alias("related_party_ratio_pct"),
    )
    return items.join(sums, ["code", "year"], "full")


def provenance(items: DataFrame, cells: DataFrame) -> DataFrame:
    """Where the values of (code, year, dim, name, amount) stand: in the table of the report that holds most of its names, the first
    row and cell with the name (equal without space and punctuation), and in that row the first number within 1, or a
    millionth, of the amount. Items whose name that table lacks have no row here."""
    want = items.select("code", "year", "dim", "name", "amount", T.normal_name(F.col("name")).alias("key")).where("key <> ''")
    keys = want.select("code", "year", "key").distinct()
    named = cells.select(*TABLE, "r", "c", T.normal_name(F.col("v")).alias("key")).where("key <> ''").join(keys, ["code", "year", "key"])
    hits = named.groupBy(*TABLE).agg(F.count_distinct("r").alias("n"))
    best = hits.groupBy("code", "year").agg(F.max_by("table_id", F.struct("n", -F.col("table_id"))).alias("table_id"))
    first = named.join(best, list(TABLE)).groupBy(*TABLE, "key").agg(F.min(F.struct("r", "c")).alias("at")).select(*TABLE, "key", "at.r", F.col("at.c").alias("name_c"))
    placed = want.join(first, ["code", "year", "key"])
    numbers = cells.select(*TABLE, "r", "c", T.parse_money(F.col("v")).alias("x")).where("x is not null")
    band = F.greatest(F.lit(1.0), F.abs("amount") * 1e-6)
    near = F.when(F.abs(F.col("x") - F.col("amount")) <= band, F.col("c"))
    return placed.join(numbers, [*TABLE, "r"], "left").groupBy("code", "year", "dim", "name", "table_id", "r", "name_c").agg(F.min(near).alias("amount_c"))


def serialized(cells: DataFrame, most: int = 40) -> DataFrame:
    """A table for a prompt: of its first ``most`` rows the filled cells, joined by bars, rows without any left out."""
    value = T.strip(F.replace("v", F.lit("\n"), F.lit(" ")))
    full = cells.where(F.col("r") < most).withColumn("v", value).where("v <> ''")
    parts = F.array_sort(F.collect_list(F.struct("c", "v")))
    lines = full.groupBy(*TABLE, "r").agg(F.array_join(F.transform(parts, lambda x: x["v"]), " | ").alias("line"))
    return lines.groupBy(*TABLE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias("text"))


def reindexed(kept: DataFrame) -> DataFrame:
    """Items of a breakdown after folding with their new index in the dimension: provenance of a row that went goes with it."""
    w = Window.partitionBy(*TABLE, "dim").orderBy("r")
    return kept.withColumn("idx", F.row_number().over(w) - 1)
