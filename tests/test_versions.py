"""Parsers for single layouts on hand-written grids: traps, null cells, ragged rows, empty tables."""

import pytest

from tablewright.operators import versions as V

CELLS = "code string, year int, table_id int, r int, c int, v string"


def cells(spark, *tables):
    """Cells of one report; None cells stay null, rows may be ragged."""
    return spark.createDataFrame([("000001", 2025, t, r, c, v) for t, grid in enumerate(tables, 1) for r, row in enumerate(grid) for c, v in enumerate(row)], CELLS)


def got(df):
    return sorted((r.table_id, r.r, r.dim, r.name, r.amount, r.ratio) for r in df.collect())


def test_costs_take_the_column_that_adds_up(spark):
    grid = [["项目", "增减", "金额", "占营业成本比重"], ["材料", "60%", "9,000.00", "70.00%"], ["人工", "5%", "2,000.00", "28.00%"], ["其他", None, "-", "2.00%"], ["合计", None, "11,000.00", "100.00%"], ["短"]]
    # with its total the share column adds up to 200, and 60 + 5 doesn't either: no table qualifies
    assert got(V.flat_costs(cells(spark, grid))) == []
    found = got(V.flat_costs(cells(spark, [["无关"]], grid[:4])))
    assert found == [(2, 1, "costs", "材料", 9000.0, 70.0), (2, 2, "costs", "人工", 2000.0, 28.0), (2, 3, "costs", "其他", None, 2.0)]


def test_staff_total_and_lists(spark):
    grid = [["在职员工的数量合计（人）", "1,020"], ["专业构成"], ["类别", None], ["生产", "900"], ["技术", "", "120.0"], ["合计", "1,020"], ["教育程度"], ["本科", "20"]]
    assert got(V.staff_lists(cells(spark, grid))) == [(1, 0, "total", "在职员工的数量合计（人）", 1020.0, None), (1, 3, "composition", "生产", 900.0, None), (1, 4, "composition", "技术", 120.0, None), (1, 7, "education", "本科", 20.0, None)]
    assert got(V.staff_lists(cells(spark, grid[:6]))) == []


def test_rnd_prefers_the_table_that_adds_up(spark):
    head = ["项目", "本期发生额", "上期发生额"]
    wrong = [head, ["新品开发费", "5,000", "4,000"], ["检测费", "3,000", "2,000"], ["合计", "9,999", "6,000"]]
    right = [head, ["新品开发费", "5,000", "4,000"], ["检测费", "3,000", None], ["合计", "8,000", "6,000"]]
    grids = cells(spark, wrong, right, right)
    sections = spark.createDataFrame([("000001", 2025, 1, "fuzhu"), ("000001", 2025, 2, "fuzhu"), ("000001", 2025, 3, "gov")], "code string, year int, table_id int, section string")
    want = [(2, 1, "detail", "新品开发费", 5000.0, None), (2, 2, "detail", "检测费", 3000.0, None), (2, 3, "total", "合计", 8000.0, None)]
    assert got(V.rnd_details(grids, sections)) == want  # two values over 1,000 are too few for a last column
    assert {x[0] for x in got(V.rnd_details(grids, sections.where("table_id = 1")))} == {1}
    assert got(V.rnd_details(grids, sections.where("table_id = 3"))) == []


def test_partners_skip_rows_without_a_share(spark):
    grid = [["序号", "客户名称", "销售额", "占年度销售总额比例"], ["1", "甲公司", "50,000", "30%"], ["2", "乙公司", "40,000", None], ["3", "丙公司", "30,000", "20%"], ["4", None, "20,000", "9%"], ["合计", "--", "120,000", "69%"]]
    assert got(V.partners(cells(spark, grid), "client")) == [(1, 1, "client", "甲公司", 50000.0, 30.0), (1, 3, "client", "丙公司", 30000.0, 20.0), (1, 5, "total", "", 120000.0, 69.0)]
    assert got(V.partners(cells(spark, grid), "supplier")) == []


def test_buckets_leave_margin_tables(spark):
    margin = [["分产品", "营业收入", "毛利率"], ["甲", "9,000", "30%"], ["乙", "8,000", "34%"]]
    shares = [["项目", "金额", "比重", "同比"], ["分行业", None, None, None], ["制造", "17,000", "100%", "1%"], ["分 产品"], ["甲", "9,000", "53%", "-4%"], ["乙", "8,000", "47%", "8%"], ["合计", "17,000", "100%", "1%"], ["分地区"]]
    assert got(V.buckets(cells(spark, margin, shares))) == [(2, 2, "industries", "制造", 17000.0, 100.0), (2, 4, "segments", "甲", 9000.0, 53.0), (2, 5, "segments", "乙", 8000.0, 47.0)]


def test_two_years_take_the_left_one(spark):
    grid = [["", "2025年", "", "2024年", ""], ["分产品"], ["甲", "90,000", "60%", "80,000", "55%"], ["乙", "60,000", "140%", "70,000", "45%"], ["丙", None, "40%", None, None]]
    assert got(V.two_years(cells(spark, grid))) == [(1, 2, "segments", "甲", 90000.0, 60.0), (1, 3, "segments", "乙", 60000.0, None), (1, 4, "segments", "丙", None, 40.0)]


def test_continued_tables_by_a_loop(spark):
    rows = [(t, (t * 7) % 23 // 2, 1 + (t * 5) % 8, t % 3 == 0) for t in range(60)]
    want, head, width, chain = {}, None, 0, 0
    for t, page, w, repeats in sorted(rows, key=lambda x: (x[1], x[0])):
        on = head is not None and page in (head, head + 1) and abs(width - w) <= 2
        head, width, chain = (head, max(width, w), chain) if on else (page, w, chain + 1)
        want[t] = (chain, on and repeats)
    df = spark.createDataFrame([("1", 2025, *r) for r in rows], "code string, year int, table_id bigint, page int, width int, repeats boolean")
    assert {r.table_id: (r.chain, r.cut) for r in V.continued(df).collect()} == want


def test_a_page_in_one(spark):
    grids = cells(spark, [["a", None], [" b "]], [["c", "d", "e"]], [["f"]])
    pages = spark.createDataFrame([("000001", 2025, 1, 5), ("000001", 2025, 2, 5), ("000001", 2025, 3, 6)], "code string, year int, table_id int, page int")
    assert sorted((r.page, r.r, r.row) for r in V.page_merged(grids, pages).collect()) == [(5, 0, ["a", "", ""]), (5, 1, ["b", "", ""]), (5, 2, ["c", "d", "e"])]


@pytest.mark.parametrize("parse", [V.flat_costs, V.staff_lists, V.buckets, V.two_years, lambda c: V.partners(c, "client"), lambda c: V.rnd_details(c, c.selectExpr("code", "year", "table_id", "'fuzhu' as section"))])
def test_no_tables_and_empty_ones(spark, parse):
    assert parse(spark.createDataFrame([], CELLS)).count() == 0
    assert parse(cells(spark, [[None, ""]], [[None]])).count() == 0
