"""Whole parses on hand-written grids, routing, over-anchor tables, plug-ins in child processes."""

import time

import pytest

from tablewright.operators import grid as G
from tablewright.operators import isolated, reports, routing

QUESTION = "营业收入构成 分行业 分产品 分地区 销售模式"


def cells_of(spark, tables):
    """tables: {(code, year, table_id): rows}."""
    rows = [(c, y, t, r, k, v) for (c, y, t), grid in tables.items() for r, row in enumerate(grid) for k, v in enumerate(row)]
    return spark.createDataFrame(rows, "code string, year int, table_id int, r int, c int, v string")


def meta_of(spark, rows):
    return spark.createDataFrame(rows, "code string, year int, table_id int, page int, section string, caption string")


COMPOSITION = [["分产品", "营业收入", "占营业收入比重"], ["产品A", "600", "60%"], ["产品B", "400", "40%"]]
MARGIN = [["分产品", "营业收入", "营业成本", "毛利率"], ["产品A", "600", "400", "33%"], ["产品B", "400", "300", "25%"]]
STAFF = [["专业构成", "人数"], ["销售人员", "12"], ["生产人员", "40"]]


def test_margins_are_no_shares(spark):
    """Names and amounts by their headers; a share column only where the header says so."""
    got = G.resolved_columns(cells_of(spark, {("a", 2020, 1): COMPOSITION, ("a", 2020, 2): MARGIN}))
    assert {r.table_id: (r.name_col, r.amount_col, r.ratio_col) for r in got.collect()} == {1: (0, 1, 2), 2: (0, 1, None)}


def test_the_anchors_column_helps_where_no_header_does(spark):
    grid = [["", "本年", "上年"], ["产品A", "1", "600"], ["产品B", "2", "400"]]
    cells = cells_of(spark, {("a", 2020, 1): grid})
    hint = spark.createDataFrame([("a", 2020, 1, 2)], "code string, year int, table_id int, c int")
    assert G.resolved_columns(cells).first().amount_col == 1
    assert G.resolved_columns(cells, hint).first().amount_col == 2


def parse(spark, tables, anchor, captions=(), forced=None, override=None):
    keys = sorted(tables)
    caption = dict(captions)
    meta = meta_of(spark, [(*k, 10 * k[2], "management", caption.get(k[2], "")) for k in keys])
    found = sorted({k[:2] for k in keys} | {("none", 2020)})
    anchors = spark.createDataFrame([(*k, anchor, None) for k in found if k[0] != "none"] if anchor else [], "code string, year int, revenue double, main_revenue double")
    out = reports.parse(spark.createDataFrame(found, "code string, year int"), cells_of(spark, tables), meta, anchors, QUESTION, forced, override)
    return sorted(((r.code, r.status, r.via, r.table_id, r.dim, r.idx, r.name, r.amount) for r in out.collect()), key=str)


def test_a_report_from_grids_to_items(spark):
    """Unit from the caption, sections by markers, total rows, children and parents of sums left out."""
    grid = [
        ["项目", "营业收入", "占营业收入比重"], ["其他业务收入", "5", "1%"], ["分行业", "", ""], ["制造业", "700", "70%"], ["服务业", "300", "30%"],
        ["分产品", "", ""], ["机器", "600", "60%"], ["其中：大机器", "500", "50%"], ["小机器", "100", "10%"], ["配件", "400", "40%"],
        ["分地区", "", ""], ["国内", "900", "90%"], ["东部", "600", "60%"], ["西部", "300", "30%"], ["国外", "100", "10%"], ["合计", "1,000", "100%"],
    ]
    got = parse(spark, {("a", 2020, 1): grid, ("a", 2020, 3): STAFF}, 10_000_000.0, {1: "（1）营业收入构成 单位：万元"}.items())
    want = [("industries", ["制造业", "服务业"], [7e6, 3e6]), ("segments", ["机器", "配件"], [6e6, 4e6]), ("regions", ["东部", "西部", "国外"], [6e6, 3e6, 1e6])]
    flat = [("a", "ok", "anchor+dims", 1, d, i, n, a) for d, names, amounts in want for i, (n, a) in enumerate(zip(names, amounts, strict=True))]
    assert got == sorted([*flat, ("none", "no_table_found", None, None, None, None, None, None)], key=str)


def test_without_an_anchor_the_first_recalled_table_counts(spark):
    got = parse(spark, {("a", 2020, 1): STAFF, ("a", 2020, 2): COMPOSITION}, None, {2: "营业收入构成"}.items())
    assert {x[1:4] for x in got if x[0] == "a"} == {("ok", "recall", 2)}


def test_forced_tables_and_set_units(spark):
    tables = {("a", 2020, 1): COMPOSITION, ("a", 2020, 2): MARGIN}
    forced = spark.createDataFrame([("a", 2020, 2), ("b", 2020, 1), ("a", 2021, 9)], "code string, year int, table_id int")
    for unit, factor in ((10000, 1e4), (7, 1.0)):  # a factor that no report has sets nothing
        override = spark.createDataFrame([("a", 2020, unit)], "code string, year int, unit int")
        got = parse(spark, tables, 1000.0, forced=forced, override=override)
        assert [x[1:] for x in got if x[0] == "a"] == [("ok", "llm_select", 2, "segments", 0, "产品A", 600 * factor), ("ok", "llm_select", 2, "segments", 1, "产品B", 400 * factor)]


def test_over_anchor_tables_meet_the_anchor_and_are_no_traps(spark):
    trap = [["分产品", "营业收入", "毛利率", "营业收入比上年"], ["产品A", "600", "33%", "1%"], ["产品B", "400", "25%", "2%"]]
    off = [["分产品", "营业收入", "占营业收入比重"], ["产品A", "600", "60%"], ["产品B", "700", "40%"]]
    tables = {("a", 2020, 1): COMPOSITION, ("a", 2020, 2): MARGIN, ("a", 2020, 3): trap, ("a", 2020, 4): off, ("a", 2020, 5): COMPOSITION}
    meta = meta_of(spark, [(*k, k[2], "management", "") for k in tables])
    anchors = spark.createDataFrame([("a", 2020, 1000.0, None)], "code string, year int, revenue double, main_revenue double")
    for tried, most, want in (([("a", 2020, 1)], 4, [2, 5]), ([("a", 2020, 1)], 1, [5]), ([("x", 2020, 1)], 4, [1, 2, 5])):
        t = spark.createDataFrame(tried, "code string, year int, page int")
        got = reports.over_anchor(cells_of(spark, tables), meta, anchors, QUESTION, t, most)
        assert sorted(r.table_id for r in got.collect()) == want


def judged(spark, items, truths):
    df = spark.createDataFrame([("a", 2020, *x) for x in items], "code string, year int, dim string, name string, amount double, ratio double")
    known = spark.createDataFrame(truths, "field string, code string, year int, anchor double, main double, total double")
    return lambda field: routing.plausibility(routing.candidates({(field, "p"): df}), known).first()


def test_plausibility_of_shares_and_anchors(spark):
    whole = [("industries", "A", 6.0, 60.0), ("industries", "B", 4.0, 40.0)]
    r = judged(spark, whole, [])("revenue_breakdown")
    assert (r.clean, r.ok_dims, r.n_rows, r.confidence) == (True, 1, 2, "unknown")
    off = [("industries", "A", 6.0, 60.0), ("industries", "B", 2.0, 19.0)]
    assert not judged(spark, off, [])("revenue_breakdown").clean
    r = judged(spark, off, [("revenue_breakdown", "a", 2020, 8.1, None, None)])("revenue_breakdown")
    assert r.clean and r.confidence == "high"  # an anchor makes up for shares
    part = [("industries", "A", 10.0, 100.0), ("segments", "X", 5.0, 50.0)]
    r = judged(spark, part, [])("revenue_breakdown")
    assert (r.clean, r.ok_dims, r.n_dims) == (False, 1, 2)
    assert judged(spark, [], [])("revenue_breakdown") is None


def test_plausibility_of_details_and_counts(spark):
    detail = [("detail", "x", 60.0, None), ("detail", "y", 40.0, None), ("total", "sum", 100.0, None)]
    assert judged(spark, detail, [("rnd_info", "a", 2020, None, None, 100.5)])("rnd_info").clean
    assert not judged(spark, detail, [("rnd_info", "a", 2020, None, None, 103.0)])("rnd_info").clean
    assert not judged(spark, detail, [])("rnd_info").clean
    staff = [("composition", "x", 60.0, None), ("composition", "y", 42.0, None), ("education", "z", 100.0, None)]
    assert judged(spark, staff, [("employees", "a", 2020, None, None, 100.0)])("employees").clean
    assert not judged(spark, staff, [("employees", "a", 2020, None, None, 99.0)])("employees").clean


def test_the_cleanest_candidate_is_routed_to(spark):
    items = lambda *x: spark.createDataFrame([("a", 2020, *i) for i in x], "code string, year int, dim string, name string, amount double, ratio double")
    good, bad = [("industries", "A", 6.0, 60.0), ("industries", "B", 4.0, 40.0)], [("industries", "A", 6.0, 60.0), ("industries", "B", 4.0, 30.0), ("industries", "C", 4.0, 1.0)]
    empty = spark.createDataFrame([], "field string, code string, year int, anchor double, main double, total double")
    f = "revenue_breakdown"
    route = lambda found: [tuple(r) for r in routing.route(routing.plausibility(routing.candidates(found), empty)).collect()]
    found = {(f, "bad"): items(*bad), (f, "good"): items(*good), (f, "again"): items(*good)}
    assert route(found) == [(f, "a", 2020, "routed", "good", 3)]
    assert route({(f, "bad"): items(*bad)}) == [(f, "a", 2020, "needs_repair", None, 1)]
    df = routing.candidates(found)
    assert {r.source for r in routing.routed_items(df, routing.route(routing.plausibility(df, empty))).collect()} == {"good"}


GOOD = 'def parse(tables, context=None):\n    return {"industries": [{"name": "x", "revenue_yuan": len(tables), "ratio_pct": 100.0}]}'
FAULTS = {
    "endless": ("def parse(t):\n    while True: pass", "timeout"),
    "sleeps": ("import time\ndef parse(t): time.sleep(60)", "timeout"),
    "ends": ("import os\ndef parse(t): os._exit(3)", "crash"),
    "killed": ("import os, signal\ndef parse(t): os.kill(os.getpid(), signal.SIGKILL)", "crash"),
    "raises": ('def parse(t): return {"a": 1 / 0}', "error"),
    "own key error": ('def parse(t): return {}["q"]', "error"),
    "no parse": ("x = 1", "rejected"),
    "no python": ("def parse(", "rejected"),
    "empty source": ("", "rejected"),
    "shape": ('def parse(t): return {"a": [{"b": 1}]}', "malformed"),
    "list": ("def parse(t): return [1, 2]", "malformed"),
    "memory": ('def parse(t): return {"a": [{"name": "x" * (1 << 32), "revenue_yuan": 1}]}', "error"),
    "long": ('def parse(t): return {"a": [{"name": "x" * 30_000_000, "revenue_yuan": 1}]}', "too_large"),
    "talks": ("def parse(t):\n    print('noise' * 100000)\n    return None", "empty"),
}


def test_load_and_run_in_a_child():
    said = isolated.call(GOOD, b'[{"table": []}, {"table": []}]', 10, 512)
    assert said == {"status": "ok", "rows": [["industries", 0, "x", 2.0]]}


@pytest.mark.parametrize("name", FAULTS)
def test_faults_become_statuses(name):
    source, status = FAULTS[name]
    began = time.monotonic()
    for _ in range(2):  # a new child after each fault
        assert isolated.call(source, b"[]", 0.5, 512)["status"] == status
    assert time.monotonic() - began < 8
    assert isolated.call(GOOD, b"[]", 10, 512)["status"] == "ok"


def test_children_of_a_killed_child_end_too(tmp_path):
    source = f'import subprocess\ndef parse(t):\n    p = subprocess.Popen(["sleep", "300"])\n    open("{tmp_path}/pid", "w").write(str(p.pid))\n    while True: pass'
    assert isolated.call(source, b"[]", 1, 0)["status"] == "timeout"
    pid = int((tmp_path / "pid").read_text())
    for _ in range(50):
        try:
            state = open(f"/proc/{pid}/stat").read().rpartition(")")[2].split()[0]
        except FileNotFoundError:
            break
        if state == "Z":
            break
        time.sleep(0.05)
    else:
        raise AssertionError("still runs")


def test_large_reports_pass_through_the_pipe():
    big = b'[{"table_id": 1, "grid": [["' + b"x" * 5_000_000 + b'"]]}]'
    source = 'def parse(t): return {"a": [{"name": "n", "revenue_yuan": len(t[0]["grid"][0][0])}]}'
    assert isolated.call(source, big, 20, 1024)["rows"] == [["a", 0, "n", 5_000_000.0]]


def test_plugins_over_reports(spark):
    cells = cells_of(spark, {("a", 2020, 1): COMPOSITION, ("a", 2020, 2): MARGIN, ("b", 2021, 1): STAFF, ("b", 2021, 2): [[None, "x"]]})
    tables = isolated.report_tables(cells)
    assert {(r.code, r.year): [(t.table_id, t.grid) for t in r.tables] for r in tables.collect()} == {("a", 2020): [(1, COMPOSITION), (2, MARGIN)], ("b", 2021): [(1, STAFF), (2, [["", "x"]])]}
    got = isolated.run(tables, {"good": GOOD, "endless": FAULTS["endless"][0], "ends": FAULTS["ends"][0]}, limit=0.5).collect()
    assert sorted((r.code, r.plugin, r.status, r.amount) for r in got if r.code == "a") == [("a", "endless", "timeout", None), ("a", "ends", "crash", None), ("a", "good", "ok", 2.0)]
    assert len(got) == 6
    assert isolated.run(tables, {}).count() == isolated.run(tables.limit(0), {"good": GOOD}).count() == 0
