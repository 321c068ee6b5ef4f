"""Scoring, recall and selection of tables: top-k per report with gates, thresholds and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.operators.grid import DIMENSIONS, TABLE, any_of
from tablewright.session import kept

#: Signatures of the tables looked for.
SIGNATURES = {
    "revenue": {"must": ("营业收入", "分产品", "分行业", "分地区"), "exclude": ("员工", "供应商", "研发", "不良", "覆盖率", "充足率", "资本充足", "净息差", "净利差"), "rows": (8, 30), "ratio_max": 100},
    "rnd": {"must": ("职工薪酬", "研发材料", "研发费用"), "exclude": ("营业收入", "分产品", "专业构成", "供应商", "客户", "生产人员", "销售人员", "教育程度", "占比", "余额", "利息", "不良", "充足率", "销售费用", "管理费用"), "rows": (5, 15), "ratio_max": None},
    "employee": {"must": ("专业构成", "教育程度", "员工", "在职员工"), "exclude": (), "rows": (8, 25), "ratio_max": None},
    "cost": {"must": ("占营业成本比重", "营业成本构成", "成本构成", "成本"), "exclude": ("研发", "员工"), "rows": (3, 20), "ratio_max": 100},
    "client": {"must": ("客户名称", "前五名客户", "前五大客户", "主要客户", "销售额"), "exclude": ("供应商", "采购额", "采购总额"), "rows": (3, 15), "ratio_max": None},
    "supplier": {"must": ("供应商名称", "前五名供应商", "前五大供应商", "主要供应商", "采购额"), "exclude": ("客户", "销售额", "销售总额"), "rows": (3, 15), "ratio_max": None},
}


#: What stands above each kind of table, and the sections in which it's expected.
CAPTIONS = {
    "revenue": ("营业收入构成", "收入构成", "营业收入和营业成本", "主营业务分", "分部报告", "分行业", "分产品", "分地区", "分销售模式"),
    "rnd": ("研发投入", "研发情况", "研发费用"),
    "employee": ("员工情况", "专业构成", "教育程度", "员工人数", "在职员工"),
    "cost": ("营业成本构成", "成本构成", "营业收入和营业成本", "主营业务分", "分部报告"),
    "client": ("前五名客户", "前五大客户", "主要客户", "向前五名客户", "客户集中"),
    "supplier": ("前五名供应商", "前五大供应商", "主要供应商", "向前五名供应商", "供应商集中"),
}
SECTIONS = {"revenue": ("fuzhu", "management"), "rnd": ("fuzhu", "management"), "employee": ("gov", "management"), "cost": ("fuzhu", "management"), "client": ("fuzhu", "management"), "supplier": ("fuzhu", "management")}


def facts(cells: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """What signatures test, a row for each table: text, rows, number and label cells, largest share of the share column; and where
    ``meta`` (TABLE, section, caption) is given, what is said of the table's place. Cells are shuffled once: the sums by
    column and those by table both keep to the tables' partitioning."""
    v = F.col("v")
    share = F.when(v.contains("%"), T.parse_money(F.replace(v, F.lit("%"), F.lit(""))))
    piece = F.when(v != "", F.struct("r", "c", F.replace(v, F.lit("\n"), F.lit(" ")).alias("v")))
    by_column = cells.repartition(*TABLE).groupBy(*TABLE, "c").agg(
        F.collect_list(piece).alias("pieces"), F.max("r").alias("last"), F.count_if(T.is_text(v)).alias("n_text"), F.count_if(T.is_money(v)).alias("n_money"),
        F.count_if(F.coalesce(share.between(0, 100), F.lit(False))).alias("n_ratio"), F.max(F.abs(share)).alias("max_share"),
    )
    words = F.transform(F.array_sort(F.flatten(F.collect_list("pieces"))), lambda x: x["v"])
    tables = by_column.groupBy(*TABLE).agg(
        F.array_join(words, " ").alias("text"), (F.max("last") + 1).alias("n_rows"), F.max("n_ratio").alias("n_ratio"), F.max("n_money").alias("n_money"), F.sum("n_text").alias("n_text"),
        F.min_by("max_share", F.when(F.col("n_ratio") >= 3, F.col("c"))).alias("max_ratio"),
    )
    if meta is None:
        return tables.where("text <> ''")
    return tables.where("text <> ''").join(meta.select(*TABLE, "section", "caption"), list(TABLE), "left")


def parts(name: str, placed: bool = True) -> dict[str, Column]:
    """The components of a signature's score: words, words of other tables, kinds of columns, and, where the tables'
    places are known, caption and section."""
    sig = SIGNATURES[name]
    text = F.col("text")
    out = {"must": sum((F.when(text.contains(w), 25).otherwise(0) for w in sig["must"]), F.lit(0))}
    out["exclude"] = F.when(any_of(text, sig["exclude"]), -60).otherwise(0) if sig["exclude"] else F.lit(0)
    out |= {"ratio": F.when(F.col("n_ratio") >= 3, 20).otherwise(0), "amount": F.when(F.col("n_money") >= 3, 15).otherwise(0), "label": F.when(F.col("n_text") >= 5, 10).otherwise(0)}
    out["ratio_max"] = F.when(F.coalesce(F.col("max_ratio") > sig["ratio_max"], F.lit(False)), -50).otherwise(0) if sig["ratio_max"] else F.lit(0)
    if placed:
        out["caption"] = F.when(T.contains_any(F.col("caption"), CAPTIONS[name]), 40).otherwise(0)
        out["section"] = F.when(F.coalesce("section", F.lit("other")).isin(*SECTIONS[name]), 20).otherwise(-8)
    return out


def explained(tables: DataFrame, names: tuple[str, ...] = tuple(SIGNATURES), least: int = 20) -> DataFrame:
    """For every table and signature the components of the score, their sum and, if the table falls, the first reason: rows,
    must-have words (a caption of the kind makes up for them), low score. One pass for all signatures."""
    placed = "caption" in tables.columns
    each = []
    for name in names:
        p, (low, high) = parts(name, placed), SIGNATURES[name]["rows"]
        score = sum(p.values(), F.lit(0))
        named = (p["caption"] > 0) if placed else F.lit(False)
        reason = F.when(~F.col("n_rows").between(low, high), "rows").when((p["must"] == 0) & ~named, "must").when(score < least, "low")
        each.append(F.struct(F.lit(name).alias("sig"), *(v.alias(k) for k, v in p.items()), score.alias("score"), reason.alias("reject")))
    return tables.select(*TABLE, F.inline(F.array(*each)))


def scored(tables: DataFrame, names: tuple[str, ...] = tuple(SIGNATURES), least: int = 20) -> DataFrame:
    """Tables that pass a signature's gates with their score and their rank for it in the report."""
    t = explained(tables, names, least).where("reject is null")
    return t.select(*TABLE, "sig", "score", F.row_number().over(Window.partitionBy("code", "year", "sig").orderBy(F.desc("score"), "table_id")).alias("rank"))


#: Accounts that only the details of R&D expense have.
RND_DETAILS = ("研发材料", "职工薪酬")


def rnd_target(tables: DataFrame) -> DataFrame:
    """code, year, table_id, n_rows, detail: of a report's tables (facts) that pass the R&D signature those with a detail account come
    first, then the longest, then the best scored. Reports without such a table are absent."""
    t = scored(tables, ("rnd",)).join(tables.select(*TABLE, "n_rows", T.contains_any(F.col("text"), RND_DETAILS).alias("detail")), list(TABLE))
    best = F.max_by(F.struct("table_id", "n_rows", "detail"), F.struct("detail", "n_rows", -F.col("rank")))
    return t.groupBy("code", "year").agg(best.alias("b")).select("code", "year", "b.table_id", "b.n_rows", "b.detail")


def bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring characters."""
    n = F.length(text)
    return F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def likeness(docs: DataFrame, question: str) -> DataFrame:
    """Cosine of each table's text doc and a question as vectors of distinct bigrams: column ``like``. Any other vectors may take
    their place (functions.embedding)."""
    asked = sorted({question[i : i + 2] for i in range(len(question) - 1)})
    d = docs.withColumn("g", bigrams(F.col("doc")))
    both = F.size(F.array_intersect("g", F.array(*map(F.lit, asked)))).cast("double")
    return d.select(*TABLE, F.coalesce(F.try_divide(both, F.sqrt(F.size("g") * F.lit(float(len(asked))))), F.lit(0.0)).alias("like"))


def recalled_tables(docs: DataFrame, question: str, top: int = 8, threshold: float = 0.0) -> DataFrame:
    """The ``top`` tables of each report most like the question, at or above the threshold; of equals the first."""
    w = Window.partitionBy("code", "year").orderBy(F.desc("like"), "table_id")
    return likeness(docs, question).withColumn("recall", F.row_number().over(w)).where((F.col("recall") <= top) & (F.col("like") >= threshold))


def column_errors(cells: DataFrame, anchors: DataFrame, anchor: str = "revenue") -> DataFrame:
    """For each column the least relative error against the anchor: of a value times a unit, or of the
    column's sum times a unit against 1 to 6 anchors (as a share of one)."""
    v = cells.select(*TABLE, "c", T.parse_money(F.col("v")).alias("x")).where("x is not null").join(anchors.select("code", "year", F.col(anchor).cast("double").alias("a")), ["code", "year"])
    units = (1.0, 1e3, 1e4, 1e8)
    off = F.least(*(F.abs(F.col("x") * u - F.col("a")) / F.col("a") for u in units))
    s = v.groupBy(*TABLE, "c").agg(F.min(off).alias("rel_value"), F.sum("x").alias("s"), F.first("a").alias("a"))
    whole = F.least(*(F.abs(F.col("s") * u - k * F.col("a")) / F.col("a") for u in units for k in range(1, 7)))
    return s.select(*TABLE, "c", F.round(F.least("rel_value", whole), 6).alias("rel"))


def anchored(cells: DataFrame, anchors: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """Best column of each table by its error, and whether that is within the tolerance."""
    e = column_errors(cells, anchors)
    return e.groupBy(*TABLE).agg(F.min_by("c", F.struct("rel", "c")).alias("c"), F.min("rel").alias("rel")).withColumn("matched", F.col("rel") <= tolerance)


def dimension_counts(cells: DataFrame) -> DataFrame:
    """How many dimensions have a marker in some cell; markers are contained, not equal."""
    dims = {}
    for marker, dim in DIMENSIONS.items():
        dims.setdefault(dim, []).append(marker)
    return cells.groupBy(*TABLE).agg(*(F.max(F.coalesce(any_of(F.col("v"), tuple(m)), F.lit(False)).cast("int")).alias(d) for d, m in dims.items())).select(*TABLE, sum((F.col(d) for d in dims), F.lit(0)).alias("n_dims"))


def is_trap(cells: DataFrame) -> DataFrame:
    """Tables of margins by year, which look like the one looked for: gross margin and a comparison in the head."""
    top = cells.where("r < 4").groupBy(*TABLE).agg(F.max(F.coalesce(F.col("v").contains("毛利率"), F.lit(False))).alias("g"), F.max(F.coalesce(F.col("v").rlike("比上年|同比"), F.lit(False))).alias("y"))
    return top.select(*TABLE, (F.col("g") & F.col("y")).alias("trap"))


def judged(cells: DataFrame, anchors: DataFrame, meta: DataFrame | None = None, anchor: str = "revenue", dealt: bool = False) -> DataFrame:
    """A row for each table: the column that explains the anchor best and its error (null without an anchor), dimensions that it has
    markers of, and whether it's the table of large items only, by its caption or by its head. One shuffle of
    the cells, none where they are dealt by report already: all are conditional aggregates by column, then by table."""
    v, x = F.col("v"), T.parse_money(F.col("v"))
    units = (1.0, 1e3, 1e4, 1e8)
    a = F.col("_a")
    cells = cells if dealt else cells.select(*TABLE, "r", "c", "v").repartition("code", "year")
    priced = cells.join(anchors.select("code", "year", F.col(anchor).cast("double").alias("_a")), ["code", "year"], "left").withColumn("_x", x)
    x = F.col("_x")
    dims: dict[str, list[str]] = {}
    for marker, dim in DIMENSIONS.items():
        dims.setdefault(dim, []).append(marker)
    head = F.col("r") < 4
    any_ = lambda test: F.max(F.coalesce(test, F.lit(False)).cast("int"))
    c = priced.groupBy(*TABLE, "c").agg(
        F.min(F.least(*(F.abs(x * u - a) / a for u in units))).alias("value"), F.sum(x).alias("s"), F.first("_a").alias("_a"),
        *(any_(any_of(v, tuple(m))).alias(f"d_{d}") for d, m in dims.items()), any_(head & v.contains("毛利率")).alias("margin"), any_(head & v.rlike("比上年|同比")).alias("change"),
    )
    whole = F.least(*(F.abs(F.col("s") * u - k * a) / a for u in units for k in range(1, 7)))
    c = c.withColumn("rel", F.round(F.least("value", whole), 6))
    best = F.struct("rel", "c")
    t = c.groupBy(*TABLE).agg(F.min(F.when(F.col("rel").isNotNull(), best)).alias("b"), sum((F.max(f"d_{d}") for d in dims), F.lit(0)).alias("n_dims"), ((F.max("margin") > 0) & (F.max("change") > 0)).alias("head_trap"))
    t = t.select(*TABLE, F.col("b.c").alias("c"), F.col("b.rel").alias("rel"), "n_dims", "head_trap")
    if meta is None:
        return t.withColumnRenamed("head_trap", "trap")
    j = t.join(meta.select(*TABLE, "caption"), list(TABLE), "left")
    return j.withColumn("trap", F.col("head_trap") | F.coalesce(F.col("caption").contains("10%以上"), F.lit(False))).drop("head_trap", "caption")


def selected(recalled: DataFrame, tables: DataFrame) -> DataFrame:
    """One of the recalled tables for each report. With an anchor: of those with an error up to 5 % that are no trap, else of those
    with a dimension at least, else of all, that with most dimensions, then the least error to four places, then the first recalled. Without one: the first recalled."""
    t = recalled.select(*TABLE, "recall").join(tables, list(TABLE))
    good = F.coalesce(F.col("rel") <= 0.05, F.lit(False))
    tier = F.when(good & ~F.col("trap"), 0).when(good & (F.col("n_dims") >= 1), 1).when(F.col("rel").isNotNull(), 2).otherwise(3)
    key = F.struct(tier, F.when(tier < 3, -F.col("n_dims")).otherwise(0), F.coalesce(F.round("rel", 4), F.lit(0.0)), "recall")
    best = t.groupBy("code", "year").agg(F.min_by(F.struct("table_id", "c", "n_dims", "rel", tier.alias("tier")), key).alias("b"))
    via = F.when(F.col("b.tier") == 0, "anchor+dims").when(F.col("b.tier") == 1, "anchor").when(F.col("b.tier") == 2, "nearest").otherwise("recall")
    return best.select("code", "year", "b.table_id", "b.c", "b.n_dims", "b.rel", via.alias("via"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Query vectors that are broadcast at once.
QUERY_BLOCK = 4096


def recalled(queries: DataFrame, vectors: DataFrame, top: int, threshold: float, fallback: bool = True) -> DataFrame:
    """For each of a stated set of query vectors (qid, q): its top rows by cosine at or above the threshold; where none
    reaches it, the top rows of all (or none). Queries are broadcast in blocks of QUERY_BLOCK, each against all
    vectors, which aren't shuffled before ranking."""
    n = -(-queries.count() // QUERY_BLOCK)
    if n > 1:
        dealt = queries.withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(n)))
        out = None
        for k in range(n):
            part = kept(_recalled(dealt.where(F.col("_block") == k).drop("_block"), vectors, top, threshold, fallback), "recall")
            out = part if out is None else out.unionByName(part)
        return out
    return _recalled(queries, vectors, top, threshold, fallback)


def _recalled(queries: DataFrame, vectors: DataFrame, top: int, threshold: float, fallback: bool) -> DataFrame:
    s = vectors.crossJoin(F.broadcast(queries)).select("qid", "vec_id", cosine(F.col("embedding"), F.col("q")).alias("sim"))
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "vec_id")
    # ranks come first: they let Spark keep the top rows of each task before the shuffle
    t = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    best = F.max("sim").over(Window.partitionBy("qid"))
    keep = (F.col("sim") >= threshold) | ((best < threshold) if fallback else F.lit(False))
    return t.withColumn("keep", keep).where("keep").select("qid", "vec_id", F.round("sim", 4).alias("score"), "rank")
