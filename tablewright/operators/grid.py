"""Grids of cells: rendering to text, stitching, column typing, headers and row parsing.

Cells are long: (code, year, table_id, r, c, v). Typing aggregates cells to one row for each
column, then to one for each table; both steps have partial aggregates, and the second reads
what the first has partitioned. Sequential rules run as folds over one table's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import text as T

TABLE = ("code", "year", "table_id")
#: What headers of a revenue table are called, and which marker opens which dimension.
ALIASES = {"name": ("项目", "分行业", "分产品", "分地区", "分销售模式", "营业收入构成"), "revenue": ("营业收入", "金额", "收入"), "ratio": ("占营业收入比重", "营业收入比重", "占营业收入的比重", "占比"), "cost": ("营业成本",), "gross": ("毛利率",)}
DIMENSIONS = {"分行业": "industries", "按行业": "industries", "分产品": "segments", "按产品": "segments", "分地区": "regions", "按地区": "regions", "分销售模式": "by_channel", "分销售渠道": "by_channel", "销售模式": "by_channel", "按销售模式": "by_channel", "销售渠道": "by_channel", "按销售渠道": "by_channel"}


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    out = c.contains(words[0])
    for w in words[1:]:
        out |= c.contains(w)
    return out


def column_stats(cells: DataFrame) -> DataFrame:
    """For each column of each table: its rows and its text, number and share cells."""
    v = F.col("v")
    in_range = v.contains("%") & T.parse_ratio(v).between(0, 100)
    return cells.groupBy(*TABLE, "c").agg(
        F.count_if(F.coalesce(v != "", F.lit(False))).alias("n_cells"), F.count_if(T.is_text(v)).alias("n_text"), F.count_if(T.is_money(v)).alias("n_money"), F.count_if(F.coalesce(in_range, F.lit(False))).alias("n_ratio")
    )


def column_types(cells: DataFrame, first_amount: bool = False) -> DataFrame:
    """Share, amount and name column of each table. Share: the first with 3 share cells. Amount: most number
    cells, 3 at least (or the first such column); if that is the share column, the first other with 2. Name:
    the first other column with 3 text cells, else the one with most; 0 where there is none."""
    s = column_stats(cells)
    ratio = F.min(F.when(F.col("n_ratio") >= 3, F.col("c"))).over(Window.partitionBy(*TABLE)).alias("ratio_col")
    s = s.select("*", ratio)
    order = F.col("c") if first_amount else F.struct(-F.col("n_money"), "c")
    best = F.min_by("c", F.when(F.col("n_money") >= 3, order)).over(Window.partitionBy(*TABLE)).alias("best")
    s = s.select("*", best)
    other = F.min(F.when((F.col("n_money") >= 2) & ~F.col("c").eqNullSafe(F.col("ratio_col")), F.col("c"))).over(Window.partitionBy(*TABLE))
    s = s.withColumn("amount_col", F.when(F.col("best").eqNullSafe(F.col("ratio_col")) & F.col("best").isNotNull(), other).otherwise(F.col("best")))
    free = ~F.col("c").eqNullSafe(F.col("ratio_col")) & ~F.col("c").eqNullSafe(F.col("amount_col"))
    return s.groupBy(*TABLE).agg(
        F.coalesce(F.min(F.when(free & (F.col("n_text") >= 3), F.col("c"))), F.min_by("c", F.when(free & (F.col("n_text") > 0), F.struct(-F.col("n_text"), "c"))), F.lit(0)).alias("name_col"),
        F.coalesce(F.first("amount_col"), F.lit(0)).alias("amount_col"),
        F.coalesce(F.first("ratio_col"), F.lit(0)).alias("ratio_col"),
        F.count("*").alias("col_count"),
    )


def headers(cells: DataFrame, rows: int = 3) -> DataFrame:
    """Text of the first rows of each column, joined by spaces."""
    top = cells.where((F.col("r") < rows) & F.coalesce(F.col("v") != "", F.lit(False)))
    parts = F.array_sort(F.collect_list(F.struct("r", F.replace("v", F.lit("\n"), F.lit("")).alias("v"))))
    return top.groupBy(*TABLE, "c").agg(F.array_join(F.transform(parts, lambda x: x["v"]), " ").alias("header"))


def header_columns(cells: DataFrame) -> DataFrame:
    """For each role: the leftmost column whose header names it, and from there the nearest column whose cells are
    of its kind (at least 2, or 1 in tiny tables); ties go left."""
    h = headers(cells)
    heads = h.groupBy(*TABLE).agg(*(F.min(F.when(any_of(F.col("header"), words), F.col("c"))).alias(f"h_{role}") for role, words in ALIASES.items()))
    s = column_stats(cells).withColumn("n_rows", F.max("n_cells").over(Window.partitionBy(*TABLE)))
    kind = {"name": "n_text", "revenue": "n_money", "ratio": "n_ratio", "cost": "n_money", "gross": "n_ratio"}
    least = F.least(F.lit(2), F.greatest(F.lit(1), F.col("n_rows") - 1))
    near = lambda role: F.min_by("c", F.when(F.col(kind[role]) >= least, F.struct(F.abs(F.col("c") - F.col(f"h_{role}")), "c")))
    found = s.join(heads, list(TABLE), "left").groupBy(*TABLE).agg(*(near(role).alias(role) for role in ALIASES), *(F.first(f"h_{role}").alias(f"h_{role}") for role in ALIASES))
    return found.select(*TABLE, *(F.when(F.col(f"h_{role}").isNotNull(), F.col(role)).alias(role) for role in ALIASES))


def resolved_columns(cells: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Name, amount and share column of each table. By header; else the first column with two text cells (or the first of
    all) and, for the amount, the column that ``hints`` (TABLE, c) names, or the first other one with two numbers. A share column
    only by its header, so that margins don't pass for shares."""
    s = column_stats(cells)
    kinds = s.groupBy(*TABLE).agg(F.min(F.when(F.col("n_text") >= 2, F.col("c"))).alias("t"), F.array_sort(F.collect_list(F.when(F.col("n_money") >= 2, F.col("c")))).alias("m"))
    j = header_columns(cells).join(kinds, list(TABLE))
    if hints is None:
        j = j.withColumn("hint", F.lit(None).cast("int"))
    else:
        j = j.join(hints.select(*TABLE, F.col("c").alias("hint")), list(TABLE), "left")
    ratio = F.when(~F.col("revenue").eqNullSafe(F.col("ratio")), F.col("ratio"))
    j = j.withColumn("name_col", F.coalesce("name", "t", F.lit(0))).withColumn("ratio_col", ratio)
    free = F.get(F.filter("m", lambda x: (x != F.col("name_col")) & ~x.eqNullSafe(F.col("ratio_col"))), F.lit(0))
    return j.select(*TABLE, "name_col", F.coalesce("revenue", "hint", free).alias("amount_col"), "ratio_col")


def ratio_sum_column(cells: DataFrame, low: float = 90, high: float = 110) -> DataFrame:
    """The leftmost column with two shares or more that sum to low..high, with or without those of 99.5 and more."""
    v = T.parse_ratio(F.col("v"))
    share = F.when(F.col("v").contains("%") & v.between(0, 100), v)
    s = cells.withColumn("share", share).groupBy(*TABLE, "c").agg(F.count("share").alias("n"), F.round(F.sum("share"), 6).alias("whole"), F.round(F.sum(F.when(F.col("share") < 99.5, F.col("share"))), 6).alias("parts"))
    ok = (F.col("n") >= 2) & (F.col("whole").between(low, high) | F.col("parts").between(low, high))
    return s.groupBy(*TABLE).agg(F.min(F.when(ok, F.col("c"))).alias("c"))


def table_class(cells: DataFrame) -> DataFrame:
    """composition, margin or unknown, by the first four rows."""
    top = cells.where("r < 4").groupBy(*TABLE).agg(F.bool_or(any_of(F.col("v"), ALIASES["ratio"])).alias("share"), F.bool_or(any_of(F.col("v"), ALIASES["gross"])).alias("gross"))
    return top.select(*TABLE, F.when(F.coalesce("share", F.lit(False)), "composition").when(F.coalesce("gross", F.lit(False)), "margin").otherwise("unknown").alias("table_class"))


def widths(cells: DataFrame) -> DataFrame:
    """Modal row width (first seen on ties) and largest row width."""
    rows = cells.groupBy(*TABLE, "r").agg((F.max("c") + 1).alias("w"))
    n = rows.groupBy(*TABLE, "w").agg(F.count("*").alias("n"), F.min("r").alias("first"))
    return n.groupBy(*TABLE).agg(F.max_by("w", F.struct("n", -F.col("first"))).alias("modal"), F.max("w").alias("widest"))


def row_text(cells: DataFrame, separator: str = " | ") -> DataFrame:
    """Rows as pipe text without columns and rows that are empty throughout."""
    filled = cells.withColumn("used", F.max(F.coalesce(F.col("v") != "", F.lit(False))).over(Window.partitionBy(*TABLE, "c"))).where("used")
    parts = F.array_sort(F.collect_list(F.struct("c", F.coalesce(F.replace("v", F.lit("\n"), F.lit(" ")), F.lit("")).alias("v"))))
    rows = filled.groupBy(*TABLE, "r").agg(F.array_join(F.transform(parts, lambda x: x["v"]), separator).alias("line"), F.max(F.coalesce(F.col("v") != "", F.lit(False))).alias("any"))
    return rows.where("any").select(*TABLE, "r", "line")


def table_text(cells: DataFrame) -> DataFrame:
    """All text of a table in reading order, one space between cells."""
    parts = F.array_sort(F.collect_list(F.struct("r", "c", F.replace("v", F.lit("\n"), F.lit(" ")).alias("v"))))
    full = cells.where(F.coalesce(F.col("v") != "", F.lit(False)))
    return full.groupBy(*TABLE).agg(F.array_join(F.transform(parts, lambda x: x["v"]), " ").alias("text"))


def text_doc(cells: DataFrame, captions: DataFrame | None = None, most: int = 300) -> DataFrame:
    """What recall compares: the table's caption, where ``captions`` (TABLE, caption) has one, and its distinct
    label-like cells (two ideographs or more without digits and punctuation)."""
    label = F.regexp_replace("v", r"[0-9.,%，。、()（）\-—:：\s年]", "")
    two = r"(?s)[\x{4E00}-\x{9FFF}].*[\x{4E00}-\x{9FFF}]"  # most cells are numbers and go before their characters are looked at
    full = cells.where(F.col("v").rlike(two)).withColumn("label", label).where(F.col("label").rlike(two))
    parts = F.array_sort(F.collect_list(F.struct("r", "c", "label")))
    docs = full.groupBy(*TABLE).agg(F.array_join(F.array_distinct(F.transform(parts, lambda x: x["label"])), " ").alias("doc"))
    if captions is not None:
        docs = docs.join(captions.select(*TABLE, "caption"), list(TABLE), "left").withColumn("doc", F.concat_ws(" ", F.nullif(F.trim("caption"), F.lit("")), "doc"))
    return docs.select(*TABLE, F.substring("doc", 1, most).alias("doc"))


def grid_rows(cells: DataFrame) -> DataFrame:
    """One row for each grid row: ``row``, its cells in order without line breaks and outer space, '' for none."""
    value = F.coalesce(T.strip(F.replace("v", F.lit("\n"), F.lit(""))), F.lit(""))
    at = F.map_from_entries(F.collect_list(F.struct("c", value.alias("v"))))
    rows = cells.groupBy(*TABLE, "r").agg(at.alias("at"), F.max("c").alias("last"))
    return rows.select(*TABLE, "r", F.transform(F.sequence(F.lit(0), "last"), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(""))).alias("row"))


def marked_rows(cells: DataFrame) -> DataFrame:
    """The grid's rows and the dimension whose marker each holds: exactly in a cell, or at the end of a
    cell with six characters more at most if the row has no number."""
    exact = loose = None
    for marker, dim in DIMENSIONS.items():
        e = F.array_contains("row", marker)
        s = F.exists("row", lambda x: x.endswith(marker) & (F.length(x) <= len(marker) + 6))  # noqa: B023
        exact = F.when(e, dim) if exact is None else exact.when(e, dim)
        loose = F.when(s, dim) if loose is None else loose.when(s, dim)
    return grid_rows(cells).withColumn("marker", F.coalesce(exact, F.when(~F.exists("row", T.is_money), loose)))


def filled_dimension(rows: DataFrame, default: str = "segments") -> DataFrame:
    """The dimension that holds for each row, that of the last marker or the default before any; ``seg``
    counts the markers so far; ``before_first`` where the table has markers, but none so far."""
    before = Window.partitionBy(*TABLE).orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("marker", ignorenulls=True).over(before)
    any_marker = F.max(F.col("marker").isNotNull()).over(Window.partitionBy(*TABLE))
    return rows.withColumns({"dim": F.coalesce(last, F.lit(default)), "before_first": last.isNull() & any_marker, "seg": F.count("marker").over(before)})


def row_items(rows: DataFrame, empty: bool = False) -> DataFrame:
    """(name, amount) of data rows, from the columns name_col and amount_col where ``rows`` has them, else from the
    first two. A row of one or two filled cells is one text: its first word is the name, its first number the
    amount. Names are cut at a double space and after 120 characters. Marker rows, header names, totals and
    rows without an amount go (``empty`` keeps these), as does other income before the first marker."""
    name_at, amount_at = (F.col(c) if c in rows.columns else F.lit(i) for i, c in enumerate(("name_col", "amount_col")))
    filled = F.filter("row", lambda x: x != "")
    words = F.filter(F.split(filled[0], " "), lambda x: x != "")
    single = F.size(filled) <= 2
    at_amount = F.coalesce(F.get("row", amount_at), F.lit(""))
    name = F.when(single, F.get(words, F.lit(0))).otherwise(F.get("row", name_at))
    number = F.get(F.filter(F.transform(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), T.parse_money), lambda x: x.isNotNull()), F.lit(0))
    amount = F.when(single, number).otherwise(T.parse_money(F.when(~at_amount.contains("%"), at_amount)))
    r = rows.where("marker is null").where(F.size(filled) > 0).withColumn("name", name).withColumn("amount", amount)
    keep = F.coalesce((F.col("name") != "") & ~F.col("name").isin("项目", "项 目") & ~T.is_total(F.col("name")), F.lit(False))
    preamble = F.col("before_first") & F.replace("name", F.lit(" "), F.lit("")).isin("其他业务", "其他业务收入")
    if not empty:
        keep &= F.col("amount").isNotNull()
    short = F.substring(T.strip(F.split("name", "  ")[0]), 1, 120)
    return r.where(keep & ~preamble).select(*TABLE, "r", "dim", "seg", short.alias("name"), "amount")


def first_of_name(items: DataFrame) -> DataFrame:
    """The first row of each (dimension, name)."""
    w = Window.partitionBy(*TABLE, "dim", "name").orderBy("r")
    return items.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def without_children(items: DataFrame, slack: float = 1.02) -> DataFrame:
    """Drops the rows of 'of which' runs and repeated names. A name that begins with 其中 never stays. It opens a run
    if it has an amount and the last row that stayed in the dimension has one that isn't 0: rows
    after it go too while their sum with the first is at most slack times that amount. A row beyond it, and a new
    marker (``seg``, if there is one), end the run. Rows without an amount go and change nothing else.
    One fold over the rows of a dimension."""
    seg = F.col("seg") if "seg" in items.columns else F.lit(0)
    rows = items.groupBy(*TABLE, "dim").agg(F.array_sort(F.collect_list(F.struct("r", seg.cast("bigint").alias("seg"), "name", "amount"))).alias("rows"))
    state = "struct<last:double,parent:double,cum:double,seg:bigint,names:array<string>,kept:array<struct<r:int,name:string,amount:double>>>"

    def step(a, x):
        opens, amount = x["name"].startswith("其中"), x["amount"]
        parent = F.when(a["seg"] == x["seg"], a["parent"])  # of the run that is open here
        to = lambda last, parent, cum, names, kept: F.struct(last.alias("last"), parent.cast("double").alias("parent"), cum.alias("cum"), x["seg"].alias("seg"), names.alias("names"), kept.alias("kept"))
        begun = F.when((a["last"] != 0) & amount.isNotNull(), a["last"])
        total = a["cum"] + amount
        new = ~F.array_contains(a["names"], x["name"])
        item = F.struct(x["r"].alias("r"), x["name"].alias("name"), amount.alias("amount"))
        return (
            F.when(opens, to(a["last"], begun, F.coalesce(amount, F.lit(0.0)), a["names"], a["kept"]))
            .when(amount.isNull(), to(a["last"], parent, a["cum"], a["names"], a["kept"]))
            .when(parent.isNotNull() & (total <= parent * slack), to(a["last"], parent, total, a["names"], a["kept"]))
            .when(new, to(amount, F.lit(None), F.lit(0.0), F.array_append(a["names"], x["name"]), F.array_append(a["kept"], item)))
            .otherwise(to(a["last"], F.lit(None), F.lit(0.0), a["names"], a["kept"]))
        )

    start = F.expr(f"cast(named_struct('last', null, 'parent', null, 'cum', 0D, 'seg', 0L, 'names', array(), 'kept', array()) as {state})")
    return rows.select(*TABLE, "dim", F.explode(F.aggregate("rows", start, step, lambda a: a["kept"])).alias("x")).select(*TABLE, "x.r", "dim", "x.name", "x.amount")


def without_parents(items: DataFrame, low: float = 0.99, high: float = 1.01) -> DataFrame:
    """Drops a row whose next two or more siblings add up to it within a percent; the search goes on after them."""
    rows = items.groupBy(*TABLE, "dim").agg(F.array_sort(F.collect_list(F.struct("r", "name", "amount"))).alias("rows"))

    def children(x, i):
        """How many rows after i add up to x: 0 for none."""
        state = "struct<sum:double,n:int,found:int>"
        start = F.expr(f"cast(named_struct('sum', 0D, 'n', 0, 'found', 0) as {state})")

        def add(a, y):
            total, n = a["sum"] + y["amount"], (a["n"] + 1).cast("int")
            stop = (a["found"] > 0) | (a["sum"] > x["amount"] * high)
            hit = (n >= 2) & (total >= x["amount"] * low) & (total <= x["amount"] * high)
            return F.when(stop, a).otherwise(F.struct(total.alias("sum"), n.alias("n"), F.when(hit, n).otherwise(0).cast("int").alias("found")))

        return F.aggregate(F.slice(F.col("rows"), i + 2, F.size("rows")), start, add, lambda a: a["found"])

    sized = rows.withColumn("runs", F.transform("rows", lambda x, i: F.when(x["amount"] > 0, children(x, i)).otherwise(F.lit(0)).cast("int")))
    state = "struct<i:int,skip:int,drop:array<int>>"
    start = F.expr(f"cast(named_struct('i', 0, 'skip', 0, 'drop', array()) as {state})")

    def walk(a, n):
        free = a["i"] >= a["skip"]
        fold = free & (n > 0)
        return F.struct((a["i"] + 1).cast("int").alias("i"), F.when(fold, a["i"] + n + 1).otherwise(a["skip"]).cast("int").alias("skip"), F.when(fold, F.array_append(a["drop"], a["i"])).otherwise(a["drop"]).alias("drop"))

    dropped = F.aggregate("runs", start, walk, lambda a: a["drop"])
    kept = sized.withColumn("dropped", dropped).select(*TABLE, "dim", F.filter("rows", lambda x, i: ~F.array_contains("dropped", i)).alias("rows"))
    return kept.select(*TABLE, "dim", F.explode("rows").alias("x")).select(*TABLE, "x.r", "dim", "x.name", "x.amount")


def stitched(tables: DataFrame) -> DataFrame:
    """Chains of tables that go on across a gap or a page: one running sum over a break flag. ``tables`` has page, top,
    bottom, page_h and cols; a table continues the chain before it if its width is that of the chain and it begins within
    35 points of the last table on the same page, or at the top of the next page after one that ended at the
    bottom. A chain's tables all have its head's width, so comparing with the last one is comparing with the head."""
    w = Window.partitionBy("code", "year").orderBy("page", "top", "table_id")
    prev = lambda c: F.lag(c).over(w)
    gap = F.col("top") - prev("bottom")
    same_page = (F.col("page") == prev("page")) & (gap >= 0) & (gap < 35)
    next_page = (F.col("page") == prev("page") + 1) & (prev("bottom") >= F.coalesce(prev("page_h"), F.lit(1e9)) - 80) & (F.col("top") <= 130)
    goes_on = F.coalesce((F.col("cols") == prev("cols")) & (F.col("cols") != 0) & (same_page | next_page), F.lit(False))
    return tables.withColumn("starts", (~goes_on).cast("int")).withColumn("chain", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def stitched_rows(cells_rows: DataFrame) -> DataFrame:
    """Rows of chained tables in order; a first row that repeats the head's header goes. Input: chain, ord (table order in the
    chain), r, line."""
    head = Window.partitionBy("code", "year", "chain").orderBy("ord", "r")
    first = F.first("line").over(head.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = cells_rows.withColumn("head", first).where(~((F.col("ord") > 0) & (F.col("r") == 0) & (F.col("line") == F.col("head"))))
    return kept.withColumn("row", F.row_number().over(head) - 1).drop("head")
