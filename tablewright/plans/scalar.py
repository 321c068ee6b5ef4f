"""Scalar functions over cell-like strings made from the parts and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.plans.base import VIEWS, query

VIEWS["strs"] = """
    SELECT p_partkey AS id, p_size AS size, p_retailprice AS price,
           CASE p_partkey % 16
             WHEN 0 THEN @money(p_retailprice) WHEN 1 THEN concat('(', CAST(p_size AS STRING), '.50%)') WHEN 2 THEN concat('  ', @money(p_retailprice), '　')
             WHEN 3 THEN concat(CAST(p_size AS STRING), '.25%') WHEN 4 THEN concat('产品', CAST(p_size AS STRING)) WHEN 5 THEN '合 计' WHEN 6 THEN '营业收入'
             WHEN 7 THEN concat('（', CAST(p_size AS STRING), '，', '000%）') WHEN 8 THEN '' WHEN 9 THEN concat('0x', CAST(p_size AS STRING)) WHEN 10 THEN concat(CAST(p_size AS STRING), 'd')
             WHEN 11 THEN concat('-', CAST(p_size AS STRING), '，', '125.5') WHEN 12 THEN 'nan' WHEN 13 THEN concat('小计 ', p_brand) WHEN 14 THEN NULL ELSE concat(CAST(p_size AS STRING), 'e3') END AS s,
           CASE p_partkey % 13
             WHEN 0 THEN '（货币单位：人民币千元）' WHEN 1 THEN '(单位：万元)' WHEN 2 THEN '单位: 人民币百万元 币种' WHEN 3 THEN '金额单位为人民币亿元' WHEN 4 THEN '单位：元' WHEN 5 THEN '单位：股' WHEN 6 THEN '没有'
             WHEN 7 THEN '（单位：十万元）' WHEN 8 THEN '(货币单位:人民币元)' WHEN 9 THEN '单位：千万元' WHEN 10 THEN '' WHEN 11 THEN NULL ELSE '单位为 千元' END AS u,
           CASE p_partkey % 5 WHEN 0 THEN concat(p_brand, '银行') WHEN 1 THEN concat(p_brand, '（证券）') WHEN 2 THEN NULL ELSE concat(' ', p_brand, '、(', p_type, ')：') END AS nm,
           concat('客户', CAST(p_size AS STRING), ' ', CASE WHEN p_partkey % 3 = 0 THEN '甲 ' ELSE '' END, @money(p_retailprice), ' ', CAST(p_size AS STRING), '.5% 备注') AS toks
    FROM part"""

# the number of a cell in SQL: a guard like the one in the functions, then a cast
NUM = r"CASE WHEN regexp_full_match({0}, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({0} AS DOUBLE) END"
STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(12288) || chr(160))"
MONEY = NUM.format(STRIP.format("translate({0}, ',，', '')"))
RATIO = NUM.format(STRIP.format("translate(translate({0}, '(（', '--'), '%,)）', '')"))


@query("q_parse_money", f"SELECT id, {MONEY.format('s')} AS v FROM strs")
def parse_money(load):
    return load("strs").select("id", T.parse_money(F.col("s")).alias("v"))


@query("q_parse_ratio", f"SELECT id, {RATIO.format('s')} AS v FROM strs")
def parse_ratio(load):
    return load("strs").select("id", T.parse_ratio(F.col("s")).alias("v"))


@query("q_cell_types", f"""SELECT id, {MONEY.format('s')} IS NOT NULL AS is_money, coalesce(regexp_matches(s, '[一-鿿]'), false) AS is_text,
       coalesce(contains(s, '%') AND abs({RATIO.format('s')}) <= 100, false) AS is_ratio FROM strs""")
def cell_types(load):
    s = F.col("s")
    return load("strs").select("id", T.is_money(s).alias("is_money"), T.is_text(s).alias("is_text"), T.is_ratio(s).alias("is_ratio"))


@query("q_total_rows", """WITH n AS (SELECT id, translate(s, ' 　', '') AS n FROM strs)
SELECT id, n FROM n WHERE contains(n, '合计') OR contains(n, '总计') OR contains(n, '小计') OR contains(n, '总额') OR contains(n, '合計')
   OR n IN ('营业收入', '主营业务收入', '营业总收入', '营业收入合计', '营业收入总额', '主营业务收入合计', '营业成本')""")
def total_rows(load):
    return load("strs").where(T.is_total(F.col("s"))).select("id", F.translate("s", " 　", "").alias("n"))


@query("q_norm_name", "SELECT id, translate(nm, ' 　' || chr(9) || chr(10) || '、,，()（）', '') AS name, translate(nm, ' 　' || chr(9) || chr(10) || '：:', '') AS label FROM strs")
def norm_name(load):
    return load("strs").select("id", T.normal_name(F.col("nm")).alias("name"), T.normal_label(F.col("nm")).alias("label"))


_UNIT = "CASE " + " ".join(f"WHEN contains({{0}}, '{k}') THEN {v}" for k, v in sorted(T.UNITS.items(), key=lambda x: -len(x[0]))) + " END"
_PATTERN = lambda p: f"nullif(regexp_extract(u, '{p}', 1), '')"
UNIT_SQL = "coalesce(" + ", ".join(_UNIT.format(_PATTERN(p)) for p in T.UNIT_PATTERNS) + ", 1)"


@query("q_unit_detect", f"SELECT id, CAST({UNIT_SQL} AS INT) AS unit FROM strs")
def unit_detect(load):
    return load("strs").select("id", T.detect_unit(F.col("u")).alias("unit"))


@query("q_unit_convert", f"SELECT id, round(price * {UNIT_SQL}, 2) AS yuan FROM strs")
def unit_convert(load):
    return load("strs").select("id", T.to_yuan(F.col("price"), T.detect_unit(F.col("u"))).alias("yuan"))


_BANK = ", ".join("CASE " + " ".join(f"WHEN contains({_PATTERN(p)}, '{k}') OR contains('{k}', {_PATTERN(p)}) THEN {v}" for k, v in T.BANK_UNITS) + " END" for p in T.BANK_PATTERNS)


@query("q_unit_bank", f"SELECT id, CAST(coalesce({_BANK}, 1) AS INT) AS unit FROM strs")
def unit_bank(load):
    return load("strs").select("id", T.bank_unit(F.col("u")).alias("unit"))


@query("q_first_number", "SELECT id, TRY_CAST(nullif(regexp_extract(translate(translate(s, '(（', '--'), ',，%)）', ''), '(-?[0-9]+(?:[.][0-9]+)?)', 1), '') AS DOUBLE) AS v FROM strs")
def first_number(load):
    return load("strs").select("id", T.first_number(F.col("s")).alias("v"))


@query("q_first_token", f"""WITH t AS (SELECT id, string_split_regex(toks, '\\s+') AS ts FROM strs)
SELECT id, list_filter(list_transform(ts, lambda x: {MONEY.format('x')}), lambda x: x IS NOT NULL)[1] AS amount,
       list_filter(list_transform(ts, lambda x: CASE WHEN contains(x, '%') THEN {RATIO.format('x')} END), lambda x: abs(x) <= 100)[1] AS ratio FROM t""")
def first_token(load):
    return load("strs").select("id", T.first_token(F.col("toks"), False).alias("amount"), T.first_token(F.col("toks"), True).alias("ratio"))


@query("q_scope", "SELECT id, coalesce(regexp_matches(nm, '银行|证券|信托|保险|期货'), false) AS out_of_scope FROM strs")
def scope(load):
    return load("strs").select("id", T.out_of_scope(F.col("nm"), F.lit("revenue_breakdown")).alias("out_of_scope"))


@query("q_header_sig", r"SELECT id, regexp_replace(coalesce(nm, ''), '[\s0-9%,，.。():：（）\-—/]', '', 'g') || '|' || regexp_replace(coalesce(s, ''), '[\s0-9%,，.。():：（）\-—/]', '', 'g') AS sig FROM strs")
def header_sig(load):
    return load("strs").select("id", T.header_signature(F.array(F.coalesce("nm", F.lit("")), F.coalesce("s", F.lit("")))).alias("sig"))


VIEWS["pairs"] = """
    SELECT l_orderkey AS a, l_linenumber AS b, l_partkey AS c, CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN l_partkey % 19 = 0 THEN 0.0 ELSE l_extendedprice END AS ground,
           CASE l_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN l_extendedprice * 1.005 WHEN 2 THEN l_extendedprice * 1.05 WHEN 3 THEN l_extendedprice * 10000 WHEN 4 THEN l_extendedprice / 10000
             WHEN 5 THEN l_extendedprice * 3 WHEN 6 THEN l_extendedprice * 100 WHEN 7 THEN 0.0 WHEN 8 THEN l_extendedprice * 1000000 ELSE l_extendedprice END AS parsed
    FROM lineitem"""


@query("q_compare_value", """SELECT tag, count(*) AS n FROM (SELECT CASE WHEN parsed IS NULL AND ground IS NULL THEN 'match' WHEN parsed IS NULL THEN 'missing' WHEN ground IS NULL THEN 'extra'
  WHEN parsed = 0 AND ground = 0 THEN 'match' WHEN ground = 0 THEN 'value' WHEN parsed / ground > 0.99 AND parsed / ground < 1.01 THEN 'match' WHEN parsed / ground > 0.9 AND parsed / ground < 1.1 THEN 'near'
  WHEN abs(parsed / ground) > 1000 OR abs(parsed / ground) < 0.001 THEN 'unit' ELSE 'value' END AS tag FROM pairs) x GROUP BY tag""")
def compare_value(load):
    return load("pairs").groupBy(T.compare_value(F.col("parsed"), F.col("ground")).alias("tag")).agg(F.count("*").alias("n"))


@query("q_unit_scale", "SELECT scale, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN abs(parsed / nullif(ground, 0) / {s!r} - 1) < 0.05 THEN {s!r}" for s in T.SCALES) + " END AS scale FROM pairs) x GROUP BY scale")
def unit_scale(load):
    return load("pairs").groupBy(T.unit_scale(F.col("parsed"), F.col("ground")).alias("scale")).agg(F.count("*").alias("n"))


@query("q_scale", "SELECT code, year, dim, name, CAST(amount * 10000 AS DOUBLE) AS amount FROM pred WHERE k = 4")
def scale(load):
    """Unit rescue: the amounts of a report times a factor, shares left alone."""
    return load("pred").where("k = 4").select("code", "year", "dim", "name", (F.col("amount") * 10000).cast("double").alias("amount"))


@query("q_event_props", """SELECT event_type, count(*) AS n, count(TRY_CAST(json_extract_string(props, '$.k') AS VARCHAR)) AS n_key FROM events GROUP BY event_type""")
def event_props(load):
    return load("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.k")).alias("n_key"))


VIEWS["replies"] = """
    SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN concat('here: {"verdict": "pass", "n": ', CAST(conv_id AS STRING), '} done') WHEN 1 THEN concat('```json {"verdict": "hold", "n": 7} ``` and {x}') ELSE 'no object' END AS reply FROM conversations"""


@query("q_json_extract", r"""SELECT conv_id, turn, json_extract_string(j, '$.verdict') AS verdict FROM (SELECT conv_id, turn,
  coalesce(nullif(regexp_extract(reply, '```(?:json)?\s*(\{[\s\S]*?\})\s*```', 1), ''), nullif(regexp_extract(reply, '(\{[\s\S]*\})', 1), '')) AS j FROM replies) x""")
def json_extract(load):
    return load("replies").select("conv_id", "turn", F.get_json_object(T.json_in(F.col("reply")), "$.verdict").alias("verdict"))
