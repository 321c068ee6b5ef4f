"""The bank path on hand-written pages and grids."""

from tablewright.operators import banks as B
from tests.test_parsing import cells_of

WIDE = [
    ["项 目", "2024年 金额", "占比%", "附注"],
    ["营业收入", "1,000", "100%", None],
    ["利息净收入", "600", "60%", ""],
    ["", "250", "25%", "手续费及佣金净收入"],
    ["非利息净收入", "37.5%", "", ""],
    ["甲", "9", "0.9%", "名称"],
    ["甲", "9", "0.9%", ""],
    ["2023年增减", "5", "1%", ""],
    ["投资收益  （注）", "0", "140%", ""],
    ["利息净收入", "1", "1%", ""],
    ["没有数字", "-", "", ""],
]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "code string, year int, page int, text string")


def meta_of(spark, rows):
    return spark.createDataFrame(rows, "code string, year int, table_id int, page int")


def reports_of(spark, rows):
    return spark.createDataFrame(rows, "code string, year int")


def test_rows_by_rule(spark):
    """Names from other cells, shares in the amount's place, impossible shares, years, totals and repeated names."""
    got = sorted(B.segments(cells_of(spark, {("a", 2020, 1): WIDE})).collect(), key=lambda r: r.r)
    assert [(r.r, r.name, r.amount, r.ratio) for r in got] == [
        (2, "利息净收入", 600.0, 60.0),
        (3, "手续费及佣金净收入", 250.0, 25.0),
        (4, "非利息净收入", None, 37.5),
        (5, "名称", 9.0, 0.9),
        (8, "投资收益", None, None),
    ]


def test_columns_by_their_cells(spark):
    few = [["名", "1", "5%"], ["一", "2", "6%"], ["二", "x", "7%"]]
    texts = [["甲一", "乙"], ["丙", "丁"]]
    shares_first = [["5%", "1", "名"], ["6%", "2", "甲"], ["7%", "3", "乙"]]
    got = B.columns_of(cells_of(spark, {("a", 2020, 1): few, ("a", 2020, 2): texts, ("a", 2020, 3): shares_first, ("a", 2020, 4): WIDE}))
    assert {r.table_id: (r.name_col, r.amount_col, r.ratio_col) for r in got.collect()} == {1: (0, None, 2), 2: (0, None, None), 3: (2, 1, 0), 4: (0, 1, 2)}


def test_two_numbers_do_where_neither_column_has_three(spark):
    """Without a share column and without three numbers anywhere, the first column with two numbers is the amount."""
    got = B.columns_of(cells_of(spark, {("a", 2020, 1): [["名", "1"], ["甲", "2"], ["乙", ""]]})).first()
    assert (got.name_col, got.amount_col, got.ratio_col) == (0, 1, None)


def test_scores_by_words(spark):
    staff = [["营业收入", "员工"], ["利息净收入", "人数"]]
    long = [["收入构成", "利息净收入 非利息净收入"]] + [["x", "1"]] * 40
    nothing = [["利息净收入", "非利息净收入"]]
    got = B.table_scores(cells_of(spark, {("a", 2020, 1): WIDE, ("a", 2020, 2): staff, ("a", 2020, 3): long, ("a", 2020, 4): nothing}))
    assert {r.table_id: r.score for r in got.collect()} == {1: 100, 3: 60}


def test_pages_and_their_neighbours(spark):
    rows = [("a", 2020, p, "营业收入构成" if p in (3, 16, 40) else None) for p in range(1, 41)]
    rows += [("b", 2020, p, "营业收入 利息净收入" if p in (17, 30) else "") for p in range(1, 31)]
    rows += [("c", 2020, p, "利息净收入 非利息净收入") for p in range(1, 60)] + [("d", 2020, 20, "正文")]
    found = {}
    for r in B.candidate_pages(pages_of(spark, rows)).collect():
        found.setdefault(r.code, []).append(r.page)
    assert {k: sorted(v) for k, v in found.items()} == {"a": [16, 17, 39, 40], "b": [16, 17, 18], "c": list(range(16, 31))}


def test_units_near_the_pages_or_in_front(spark):
    pages = pages_of(spark, [("a", 2020, 12, "单位：人民币千元"), ("a", 2020, 19, "（单位：人民币亿元）"), ("b", 2020, 2, "单位：人民币千元"), ("b", 2020, 20, "单位：人民币百万元"), ("c", 2020, 12, "单位：人民币千元"), ("c", 2020, 20, None)])
    found = spark.createDataFrame([("a", 2020, 20), ("b", 2020, 20), ("c", 2020, 20)], "code string, year int, page int")
    assert {r.code: r.unit for r in B.page_units(pages, found).collect()} == {"a": 100000000, "b": 1000}


def test_a_bare_unit_is_the_first_that_contains_it(spark):
    """The rule takes the first unit of the list that contains the token: ten thousands and single yuan are read as millions."""
    from tablewright.functions import text as T

    texts = spark.createDataFrame([("单位：人民币万元",), ("单位：人民币元",), ("单位：元",), (None,)], "t string")
    assert [r.u for r in texts.select(T.bank_unit(texts.t).alias("u")).collect()] == [1000000, 1000000, 1, 1]


def test_whole_parse(spark):
    pages = pages_of(spark, [("a", 2020, 20, "营业收入构成 单位：人民币千元"), ("a", 2020, 30, "正文"), ("b", 2020, 20, "正文"), ("c", 2020, 20, "营业收入构成")])
    plain = [["营业收入", "1"], ["收入", "2"]]
    cells = cells_of(spark, {("a", 2020, 1): plain, ("a", 2020, 2): WIDE, ("a", 2020, 3): WIDE, ("b", 2020, 1): WIDE, ("c", 2020, 1): plain})
    # clashing names of further columns are no matter
    meta = meta_of(spark, [("a", 2020, 1, 20), ("a", 2020, 2, 21), ("a", 2020, 3, 20), ("b", 2020, 1, 20), ("c", 2020, 1, 20)]).selectExpr("*", "'x' AS text", "1 AS unit", "2 AS score")
    pages = pages.unionByName(pages_of(spark, [("a", 2020, 21, "")]))
    got = B.parse(reports_of(spark, [("a", 2020), ("b", 2020), ("c", 2020), ("d", 2020)]), pages, cells, meta).collect()
    a = sorted((r for r in got if r.code == "a"), key=lambda r: r.idx)
    assert [(r.status, r.table_id, r.unit, r.idx, r.name, r.amount, r.ratio) for r in a][:3] == [("ok", 3, 1000, 0, "利息净收入", 600000.0, 60.0), ("ok", 3, 1000, 1, "手续费及佣金净收入", 250000.0, 25.0), ("ok", 3, 1000, 2, "非利息净收入", None, 37.5)]
    assert sorted((r.code, r.status, r.table_id, r.name) for r in got if r.code != "a") == [("b", "no_table_found", None, None), ("c", "no_table_found", None, None), ("d", "no_table_found", None, None)]


def test_empty_tables(spark):
    none = B.parse(reports_of(spark, []), pages_of(spark, []), cells_of(spark, {}), meta_of(spark, []))
    assert none.count() == 0
    one = B.parse(reports_of(spark, [("a", 2020)]), pages_of(spark, []), cells_of(spark, {}), meta_of(spark, [])).first()
    assert (one.status, one.name) == ("no_table_found", None)
