"""Scalar functions on cell text, headers and page text, as Column expressions.

Absent and empty text mean the same everywhere. Numbers are plain decimals: what other
parsers take for numbers (hexadecimal, suffixes, nan, inf) is text here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that mark a total row, and names that are totals by themselves.
TOTAL_WORDS = ("合计", "总计", "小计", "总额", "合計")
GRAND_TOTALS = ("营业收入", "主营业务收入", "营业总收入", "营业收入合计", "营业收入总额", "主营业务收入合计", "营业成本")
#: Unit words and their factors to yuan.
UNITS = {"元": 1, "人民币元": 1, "千元": 1000, "万元": 10000, "十万元": 100000, "百万元": 1000000, "千万元": 10000000, "亿元": 100000000, "人民币千元": 1000, "人民币万元": 10000, "人民币百万元": 1000000, "人民币亿元": 100000000}
#: How units are announced, most specific first.
UNIT_PATTERNS = (r"[（(]货币单位[：:]\s*(?:人民币)?(\S+?)[)）]", r"[（(]单位[：:]\s*(?:人民币)?(\S+?)[)）]", r"单位[：:]\s*(?:人民币)?(\S+)", r"单位为\s*(?:人民币)?(\S+)")
#: The bank reports' own list, in the order in which it's tried.
BANK_UNITS = (("人民币百万元", 1000000), ("人民币亿元", 100000000), ("人民币万元", 10000), ("人民币千元", 1000), ("百万元", 1000000), ("亿元", 100000000), ("千万元", 10000000), ("万元", 10000), ("十万元", 100000), ("千元", 1000), ("人民币元", 1), ("元", 1))
BANK_PATTERNS = (r"[（(]货币单位[：:]\s*人民币?(\S+?)[)）]", r"[（(]单位[：:]\s*人民币?(\S+?)[)）]", r"单位[：:]\s*人民币?(\S+)")
#: Names of companies that report by other rules.
FINANCIAL = ("银行", "证券", "信托", "保险", "期货")
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
#: White space as the regular expressions' \s has it, ideographic and no-break space.
SPACE = " \t\n\x0b\f\r\u3000\u00a0"


def strip(c: Column) -> Column:
    """Without white space at the ends, ideographic and no-break space included."""
    return F.trim(c, F.lit(SPACE))


def plain_number(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def parse_money(c: Column) -> Column:
    """A number with thousands separators of either width; null for anything else."""
    return plain_number(strip(F.replace(F.replace(c, F.lit(","), F.lit("")), F.lit("，"), F.lit(""))))


def parse_ratio(c: Column) -> Column:
    """A percentage as a number; parentheses of either width mean minus."""
    return plain_number(strip(F.translate(F.translate(c, "(（", "--"), "%,)）", "")))


def is_text(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[\x{4E00}-\x{9FFF}]"), F.lit(False))


def is_money(c: Column) -> Column:
    return parse_money(c).isNotNull()


def is_ratio(c: Column) -> Column:
    return F.coalesce(c.contains("%") & (F.abs(parse_ratio(c)) <= 100), F.lit(False))


def is_total(c: Column) -> Column:
    name = F.translate(c, " 　", "")
    return F.coalesce(name.rlike("|".join(TOTAL_WORDS)) | name.isin(*GRAND_TOTALS), F.lit(False))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    out = c.contains(words[0])
    for w in words[1:]:
        out |= c.contains(w)
    return F.coalesce(out, F.lit(False))


def anchor_summary(anchor: Column) -> Column:
    """An anchor in hundred millions; a fixed phrase without one."""
    return F.when(anchor.isNull() | (anchor == 0), "无锚").otherwise(F.format_string("%.2f亿", anchor / 1e8))


def dim_summary(dim: Column, total: Column, match: Column) -> Column:
    """A dimension's sum in hundred millions and whether it meets the anchor."""
    return F.format_string("%s=%.0f亿(%s)", dim, F.coalesce(total, F.lit(0.0)) / 1e8, F.when(match, "过锚").otherwise("✗"))


def overlap(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1, tol: float = 3) -> Column:
    """Whether two rectangles meet, or come within the tolerance."""
    return ~((ax1 < bx0 - tol) | (bx1 < ax0 - tol) | (ay1 < by0 - tol) | (by1 < ay0 - tol))


def caption_above(lines: Column, top: Column) -> Column:
    """The last three filled ones of the lines above a table, joined; nothing for a table at the very top."""
    full = F.filter(F.transform(lines, strip), lambda x: x != "")
    return F.when(top > 1, F.array_join(F.slice(full, F.greatest(F.size(full) - 2, F.lit(1)), 3), " ")).otherwise("")


def normal_name(c: Column) -> Column:
    """Names as scores and provenance compare them."""
    return F.translate(c, " 　\t\n、,，()（）", "")


def normal_label(c: Column) -> Column:
    """Names as anchors compare them."""
    return F.translate(c, " 　\t\n：:", "")


def _longest_unit(token: Column) -> Column:
    out = None
    for k, v in sorted(UNITS.items(), key=lambda x: -len(x[0])):
        out = F.when(token.contains(k), v) if out is None else out.when(token.contains(k), v)
    return out


def detect_unit(c: Column) -> Column:
    """The factor of the longest known unit in the first announcement that holds one; 1 without."""
    found = [_longest_unit(F.nullif(F.regexp_extract(c, p, 1), F.lit(""))) for p in UNIT_PATTERNS]
    return F.coalesce(*found, F.lit(1))


def bank_unit(c: Column) -> Column:
    """The bank path's rule: the first unit that contains the token or is contained in it. Tokens are elements of an array, so
    that each is read once and not in every branch."""
    tokens = F.array(*(F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in BANK_PATTERNS))
    known = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in BANK_UNITS))
    factors = F.transform(tokens, lambda t: F.get(F.filter(known, lambda u: t.contains(u["k"]) | u["k"].contains(t)), F.lit(0))["v"])
    return F.coalesce(F.get(F.array_compact(factors), F.lit(0)), F.lit(1))


def to_yuan(amount: Column, unit: Column) -> Column:
    return F.round(amount * unit, 2)


def unit_override(unit: Column) -> Column:
    """Only factors that occur in reports may override."""
    return F.when(unit.isin(1, 1000, 10000, 100000000), unit)


def out_of_scope(name: Column, field: Column) -> Column:
    return (field == "revenue_breakdown") & F.coalesce(name.rlike("|".join(FINANCIAL)), F.lit(False))


def is_contents_page(c: Column) -> Column:
    """Three leader runs of four dots or more (the class is a fixed value)."""
    return F.coalesce(F.regexp_count(c, F.lit("[.·。．…]{4,}")) >= 3, F.lit(False))


def first_number(c: Column) -> Column:
    """The first signed number of a text, separators and percent signs dropped, parentheses as minus."""
    return F.regexp_extract(F.translate(F.translate(c, "(（", "--"), ",，%)）", ""), "(-?[0-9]+(?:[.][0-9]+)?)", 1).try_cast("double")


def first_token(c: Column, ratio: bool) -> Column:
    """The first white-space token that is a number, or that has a percent sign and is one."""
    tokens = F.split(c, r"\s+")
    test = (lambda t: is_ratio(t)) if ratio else (lambda t: is_money(t))
    token = F.get(F.filter(tokens, test), F.lit(0))
    return parse_ratio(token) if ratio else parse_money(token)


def header_signature(headers: Column) -> Column:
    """Headers without digits, punctuation and space (the class is a fixed value), joined."""
    return F.array_join(F.transform(headers, lambda h: F.regexp_replace(h, r"[\s0-9%,，.。():：（）\-—/]", "")), "|")


def compare_value(parsed: Column, ground: Column) -> Column:
    """How a parsed number relates to the one in the text: match, near, unit, value, missing or extra."""
    ratio = F.try_divide(parsed, ground)
    return (
        F.when(parsed.isNull() & ground.isNull(), "match").when(parsed.isNull(), "missing").when(ground.isNull(), "extra")
        .when((parsed == 0) & (ground == 0), "match").when(ground == 0, "value")
        .when((ratio > 0.99) & (ratio < 1.01), "match").when((ratio > 0.9) & (ratio < 1.1), "near")
        .when((F.abs(ratio) > 1000) | (F.abs(ratio) < 0.001), "unit").otherwise("value")
    )


#: Factors of unit slips, in the order in which they're tried.
SCALES = (1e6, 1e4, 1e3, 100.0, 1e-6, 1e-4, 1e-3, 0.01)


def unit_scale(parsed: Column, ground: Column) -> Column:
    """The factor that a unit slip would explain (5 %), or null."""
    ratio, out = F.try_divide(parsed, ground), None
    for s in SCALES:
        test = F.abs(ratio / s - 1) < 0.05
        out = F.when(test, s) if out is None else out.when(test, s)
    return out


def fingerprint(signature: Column) -> Column:
    return F.substring(F.md5(signature.cast("binary")), 1, 12)


def render(template: str, values: dict[str, Column]) -> Column:
    """{{key}} replaced by its value; null is empty, keys without a value stay as they are."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), F.coalesce(v.cast("string"), F.lit("")))
    return out


def json_in(c: Column) -> Column:
    """The JSON object in free text: a fenced block, else from the first { to the last }."""
    # fixed value: the pattern of a fenced block
    fenced = F.nullif(F.regexp_extract(c, r"```(?:json)?\s*(\{[\s\S]*?\})\s*```", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(c, r"(\{[\s\S]*\})", 1), F.lit(""))
    return F.coalesce(fenced, bare)
