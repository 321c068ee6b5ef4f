"""Operators on page text: sections, contents, keyword search, layout fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import text as T

REPORT = ("code", "year")
#: Chapter titles and the section they open, first match wins.
SECTIONS = ((r"第[一二三四五六七八九十]+节\s*(管理层讨论与分析|经营情况讨论与分析|董事会报告)", "management"), (r"第[一二三四五六七八九十]+节\s*公司治理", "gov"), (r"第[一二三四五六七八九十]+节\s*财务报[告表]", "fuzhu"), ("财务报表附注|会计报表附注", "fuzhu"), (r"第[一二三四五六七八九十]+节\s*备查文件", "other"))
OUTLINE = (("管理层讨论与分析", "management"), ("经营情况讨论与分析", "management"), ("董事会报告", "management"), ("公司治理", "gov"), ("财务报告", "fuzhu"), ("财务报表", "fuzhu"), ("备查文件", "other"))
#: Words that tell the kind of company, with how often each must occur.
DOC_TYPES = {"bank": (("非利息净收入", 2), ("利息净收入", 3)), "securities": (("手续费及佣金净收入", 3), ("证券经纪业务", 1)), "insurance": (("已赚保费", 2), ("退保金", 1))}
#: Keyword groups of the layout fingerprint.
GROUPS = {"rev_by_product": ("分产品", "分行业", "分地区"), "rev_construct": ("营业收入构成", "主营业务收入"), "rnd": ("研发费用", "研发投入", "职工薪酬"), "employee": ("专业构成", "教育程度", "在职员工"), "cost": ("营业成本构成", "占营业成本比重"), "supplier": ("前五名供应商", "前五大供应商"), "client": ("前五名客户", "前五大客户"), "notes": ("财务报表附注", "财务报告附注")}


def sections(pages: DataFrame) -> DataFrame:
    """The section of each page: that of the last chapter title, contents pages skipped, 'other' before any."""
    found = None
    for pattern, name in SECTIONS:
        found = F.when(F.col("text").rlike(pattern), name) if found is None else found.when(F.col("text").rlike(pattern), name)
    mark = F.when(~T.is_contents_page(F.col("text")), found)
    w = Window.partitionBy(*REPORT).orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pages.withColumn("section", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit("other")))


def sections_by_outline(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """As-of join to the outline's first-level entries: bounds and pages go in one ordered pass, so no pairs are made."""
    kind = None
    for word, name in OUTLINE:
        kind = F.when(F.col("title").contains(word), name) if kind is None else kind.when(F.col("title").contains(word), name)
    bounds = outline.where("level = 1").select(*REPORT, "page", kind.alias("mark"), F.lit(0).alias("side")).where("mark is not null")
    both = bounds.unionByName(pages.select(*REPORT, "page", F.lit(None).cast("string").alias("mark"), F.lit(1).alias("side")))
    w = Window.partitionBy(*REPORT).orderBy("page", "side", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("section", F.coalesce(F.last("mark", ignorenulls=True).over(w), F.lit("other"))).where("side = 1").select(*REPORT, "page", "section")


def counted(word: str) -> Column:
    """How often a word occurs in the page's text."""
    return (F.length("text") - F.length(F.replace("text", F.lit(word), F.lit("")))) / len(word)


def doc_types(pages: DataFrame) -> DataFrame:
    """bank, securities, insurance or normal: all words of a kind must reach their counts over the whole report."""
    words = {w for marks in DOC_TYPES.values() for w, _ in marks}
    sums = pages.groupBy(*REPORT).agg(*(F.sum(counted(w)).cast("bigint").alias(w) for w in sorted(words)))
    out = None
    for kind, marks in DOC_TYPES.items():
        test = F.lit(True)
        for w, n in marks:
            test &= F.col(w) >= n
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return sums.select(*REPORT, out.otherwise("normal").alias("doc_type"))


def fingerprints(pages: DataFrame) -> DataFrame:
    """Kind, keyword groups that occur and the tenth of the report in which each first does, and their hash."""
    first = pages.groupBy(*REPORT).agg(F.max("page").alias("n_pages"), *(F.min(F.when(F.col("text").rlike("|".join(words)), F.col("page"))).alias(g) for g, words in GROUPS.items()))
    parts = F.array_compact(F.array(*(F.when(F.col(g).isNotNull(), F.concat(F.lit(g + ":"), F.floor(F.col(g) * 10 / F.col("n_pages")).cast("string"))) for g in sorted(GROUPS))))
    j = first.join(doc_types(pages), list(REPORT))
    sig = F.concat_ws("|", "doc_type", F.array_join(parts, ","))
    return j.select(*REPORT, "doc_type", "n_pages", sig.alias("signature"), T.fingerprint(sig).alias("hash"))


def located(pages: DataFrame, words: tuple[str, ...], around: int = 1, fallback: tuple[int, int] = (2, 4)) -> DataFrame:
    """Pages with a word and their neighbours, or a fixed range where no page has one."""
    hit = F.col("text").rlike("|".join(words))
    n = pages.groupBy(*REPORT).agg(F.max("page").alias("n_pages"), F.collect_set(F.when(hit, F.col("page"))).alias("hits"))
    near = F.array_distinct(F.flatten(F.transform("hits", lambda p: F.sequence(F.greatest(p - around, F.lit(1)), F.least(p + around, F.col("n_pages"))))))
    fixed = F.filter(F.sequence(F.lit(fallback[0]), F.lit(fallback[1])), lambda p: p <= F.col("n_pages"))
    return n.select(*REPORT, F.explode(F.when(F.size("hits") > 0, near).otherwise(fixed)).alias("page"))


def ranked(pages: DataFrame, strong: tuple[str, ...], weak: tuple[str, ...], top: int = 3, section: str = "management") -> DataFrame:
    """Ten for each strong word, one for each weak, five for the section if any word occurs; best pages first."""
    hits = sum((F.col("text").contains(w).cast("int") * 10 for w in strong), F.lit(0)) + sum((F.col("text").contains(w).cast("int") for w in weak), F.lit(0))
    s = sections(pages).withColumn("score", F.when(hits > 0, hits + F.when(F.col("section") == section, 5).otherwise(0)).otherwise(0)).where("score > 0")
    w = Window.partitionBy(*REPORT).orderBy(F.desc("score"), "page")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(*REPORT, "page", "score", "rank")


def snippets(docs: DataFrame, word: str, before: int = 2, after: int = 3) -> DataFrame:
    """Lines around the first line that holds the word."""
    lines = F.split("text", "\n")
    at = F.array_position(F.transform(lines, lambda x: x.contains(word)), True).cast("int")
    start = F.greatest(at - before, F.lit(1))
    return docs.select("doc_id", lines.alias("lines"), at.alias("at"), start.alias("start")).where("at > 0").select("doc_id", "at", F.array_join(F.slice("lines", F.col("start"), F.col("at") + after - F.col("start") + 1), "\n").alias("snippet"))


def bank_score(pages: DataFrame) -> DataFrame:
    """How sure the bank parser is of a report: two mentions in the first 80 pages."""
    n = pages.where("page <= 80").groupBy(*REPORT).agg(F.sum(counted("非利息净收入")).cast("bigint").alias("n"))
    return n.select(*REPORT, F.when(F.col("n") >= 2, 0.9).otherwise(0.3).alias("confidence"))


def clusters(prints: DataFrame) -> DataFrame:
    return prints.groupBy("hash").agg(F.count("*").alias("size"), F.min("signature").alias("signature"))


def amortization(sizes: DataFrame, levels: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95)) -> DataFrame:
    """The least number of clusters, largest first, that covers each share of the reports. Clusters are counted by
    size first, so what is ordered in one task is one row for each distinct size."""
    by_size = sizes.groupBy("size").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("size"))
    run = w.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = by_size.select("size", "n", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("n0"), F.coalesce(F.sum(F.col("n") * F.col("size")).over(run), F.lit(0)).alias("c0"), F.sum(F.col("n") * F.col("size")).over(everything).alias("total"))
    x = s.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    need = F.col("level") * F.col("total")
    hit = (F.col("c0") < need) & (F.col("c0") + F.col("n") * F.col("size") >= need)
    return x.where(hit).select("level", (F.col("n0") + F.ceil((need - F.col("c0")) / F.col("size"))).alias("n_clusters"))
