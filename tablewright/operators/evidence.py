"""Parsed fields against the report's text: what pages say of each field, in one pass, and what a parse that disagrees is called.

missing: nothing parsed, though pages speak of it | absent: nothing parsed, nothing said | mismatch: another table was parsed
column: shares don't add up | unsupported: parsed, but no page speaks of it | ok
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import text as T

#: Words by which pages speak of a field.
WORDS = {
    "revenue_breakdown": ("营业收入构成", "主营业务分产品", "分产品", "分行业"),
    "rnd_info": ("研发费用",),
    "employees": ("专业构成", "教育程度", "在职员工"),
    "cost_breakdown": ("占营业成本比重", "营业成本构成", "主营业务分行业"),
    "top_clients": ("前五名客户", "主要销售客户"),
    "top_suppliers": ("前五名供应商", "主要供应商"),
}
#: Words in items' names that belong to other tables, and from how many on they tell.
FOREIGN = {
    "revenue_breakdown": (("货币资金", "应收账款", "存货", "长期股权投资", "固定资产", "在建工程", "短期借款", "长期借款", "合同负债", "租赁负债", "吸收存款", "发放贷款", "利息收入", "利息支出"), 3),
    "rnd_info": (("资产减值准备", "递延收益", "可抵扣亏损", "内部交易未实现利润", "金融资产公允价值", "应付职工薪酬", "存货可抵减"), 2),
    "cost_breakdown": (("营业总收入", "营业总成本", "营业收入", "营业成本"), 1),
}
#: More R&D items than this are another note; shares of these fields add up to more than 98 and less than 102.
MOST_RND, SHARED = 15, ("revenue_breakdown", "cost_breakdown")
KEY = ["code", "year", "field"]


def spoken(pages: DataFrame) -> DataFrame:
    """code, year, field, n_pages and first_page of every field for every report of ``pages`` (code, year, page, text): all words of
    all fields in one pass and one grouping."""
    counts = []
    for field, words in WORDS.items():
        hit = T.contains_any(F.col("text"), words)
        counts += [F.count_if(hit).alias(f"n_{field}"), F.min(F.when(hit, F.col("page"))).alias(f"p_{field}")]
    r = pages.groupBy("code", "year").agg(*counts)
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("n_pages"), F.col(f"p_{f}").alias("first_page")) for f in WORDS))
    return r.select("code", "year", F.inline(each))


def _hits(name: Column, words: tuple[str, ...]) -> Column:
    return sum((F.coalesce(name.contains(w), F.lit(False)).cast("int") for w in words), F.lit(0))


def checked(items: DataFrame, pages: DataFrame, banks: DataFrame) -> DataFrame:
    """code, year, field, n_items, n_pages, first_page, verdict for every field of every report of ``pages``. ``items`` (field, code, year,
    dim, name, ratio) may lack reports and fields; ``banks`` (code, year) are reports that have no R&D.

    Shares count in the first dimension that the field checks: products for revenue, all for costs. Items without a name are items.
    """
    foreign = F.lit(0)
    for field, (words, _) in FOREIGN.items():
        foreign = F.when(F.col("field") == field, _hits(F.col("name"), words)).otherwise(foreign)
    counted = (F.col("field") != "revenue_breakdown") | (F.col("dim") == "segments")
    n = items.groupBy(*KEY).agg(F.count("*").alias("n_items"), F.sum(F.when(counted, foreign)).alias("foreign"), F.round(F.sum(F.when(counted, F.col("ratio"))), 2).alias("shares"))
    j = spoken(pages).join(n, KEY, "left").join(banks.select("code", "year").distinct().withColumn("bank", F.lit(True)), ["code", "year"], "left")
    parsed, said = F.coalesce(F.col("n_items") > 0, F.lit(False)), F.col("n_pages") > 0
    bank = F.coalesce("bank", F.lit(False)) & (F.col("field") == "rnd_info")
    limit = F.lit(None).cast("int")
    for field, (_, least) in FOREIGN.items():
        limit = F.when(F.col("field") == field, least).otherwise(limit)
    other = bank | F.coalesce(F.col("foreign") >= limit, F.lit(False)) | ((F.col("field") == "rnd_info") & (F.col("n_items") > MOST_RND))
    off = F.col("field").isin(*SHARED) & F.coalesce((F.col("shares") > 0) & ~((F.col("shares") > 98) & (F.col("shares") < 102)), F.lit(False))
    verdict = (
        F.when(~parsed, F.when(said & ~bank, "missing").otherwise("absent"))
        .when(other, "mismatch")
        .when(~said & (F.col("field") == "cost_breakdown"), "unsupported")
        .when(off, "column")
        .otherwise("ok")
    )
    return j.select(*KEY, F.coalesce("n_items", F.lit(0)).alias("n_items"), "n_pages", "first_page", verdict.alias("verdict"))
