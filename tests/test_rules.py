"""Fixtures for rules, folds, headers, ledgers, sources and streams."""

import json
import random

import pytest

from pyspark.sql import functions as F

from tablewright.functions import text as T
from tablewright.operators import grid as G
from tablewright.operators import ledger as L
from tablewright.operators import plugins
from tablewright.operators import reconcile as R
from tablewright.operators import scoring as S
from tablewright.sources import table_cache
from tablewright.streaming import live


def grid_cells(spark, *grids):
    rows = [("000001", 2024, i, r, c, v) for i, g in enumerate(grids) for r, row in enumerate(g) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "code string, year int, table_id int, r int, c int, v string")


COMPOSITION = [["分行业", "营业收入\n金额", "占营业收入比重", "金额(2024)", "占营业收入比重"], ["工业", "7987", "84.67%", "6304", "76.43%"], ["其他业务", "1446", "15.33%", "1944", "23.57%"]]
MARGIN = [["分产品", "营业收入", "营业成本", "毛利率", "毛利率比上年"], ["产品甲", "600", "400", "33%", "1%"], ["产品乙", "400", "300", "25%", "2%"]]


def test_headers_of_composition_and_margin_tables(spark):
    cells = grid_cells(spark, COMPOSITION, MARGIN)
    a, b = G.header_columns(cells).orderBy("table_id").collect()
    assert (a["name"], a["revenue"], a["ratio"]) == (0, 1, 2)
    assert (b["name"], b["revenue"], b["ratio"], b["cost"], b["gross"]) == (0, 1, None, 2, 3)
    assert [r.table_class for r in G.table_class(cells).orderBy("table_id").collect()] == ["composition", "margin"]


def shares(spark, *values):
    return spark.createDataFrame([("1", 2024, "industries", f"n{i}", float(v)) for i, v in enumerate(values)], "code string, year int, dim string, name string, ratio double")


def test_hard_share_rules(spark):
    def severities(*values):
        return [(r.rule, r.severity) for r in R.violations_of_shares(shares(spark, *values), "revenue").collect()]

    assert severities(60, 25, 15) == []
    assert severities(100, 90, 60) == [("ratio_sum", "red")]
    assert severities(150, 5, 5) == [("ratio_range", "red")]
    assert severities(100) == []
    assert severities(60, 30, 7) == [("ratio_sum", "warn")]


def test_hard_totals(spark):
    totals = spark.createDataFrame([("1", 2024, 1000.0)], "code string, year int, total double")

    def level(*amounts, relative=True, clean=1, warn=5):
        items = spark.createDataFrame([("1", 2024, float(a)) for a in amounts], "code string, year int, amount double")
        return [r.severity for r in R.violations_of_total(items, totals, "rnd", clean, warn, relative).collect()]

    assert level(100, 50) == ["red"] and level(600, 400) == [] and level(600, 370) == ["warn"]
    assert level(600, 401, relative=False, clean=0, warn=2) == ["warn"]


def test_plausibility_truth_table(spark):
    assert R.share_plausibility(shares(spark, 60, 40)).first().clean
    assert not R.share_plausibility(shares(spark, 60, 19)).first().clean
    totals = spark.createDataFrame([("1", 2024, 1000.0)], "code string, year int, total double")
    for amounts, clean in (((600, 400), True), ((600, 100), False), ((1000,), False)):
        items = spark.createDataFrame([("1", 2024, float(a)) for a in amounts], "code string, year int, amount double")
        assert R.detail_plausibility(items, totals).first().clean == clean


def test_confidence_takes_either_anchor(spark):
    items = spark.createDataFrame([("1", 2024, "a", 100.0), ("1", 2024, "b", 80.0), ("2", 2024, "a", 100.0), ("2", 2024, "z", 0.0), ("3", 2024, "a", 1.0)], "code string, year int, dim string, amount double")
    anchors = spark.createDataFrame([("1", 2024, 101.0, 81.0), ("2", 2024, 50.0, None)], "code string, year int, revenue double, main_revenue double")
    got = {r.code: (r.confidence, r.n_dims) for r in R.confidence(items, anchors).collect()}
    assert got == {"1": ("high", 2), "2": ("low", 1), "3": ("unknown", 1)}


def test_scores(spark):
    schema = "version string, code string, year int, dim string, name string, amount double, idx int"
    golden = spark.createDataFrame([("v", "1", 2024, "d", "户外业务", 1150774808.79, 0), ("v", "1", 2024, "d", "芯片业务", 229938287.60, 1)], schema)
    rows = golden.collect()

    def score(pred):
        return S.score_fields(golden, spark.createDataFrame(pred, schema)).first()

    same = score(rows)
    assert same.exact and same.score == 1.0
    assert not score(rows[:1]).exact and score(rows[:1]).score == 0.5
    assert score([*rows, ("v", "1", 2024, "d", "多余", 1.0, 2)]).score < 1
    near = [(*r[:5], r[5] * 1.005, r[6]) for r in rows]
    assert score(near).exact
    assert score([(*r[:5], r[5] * 1.5, r[6]) for r in rows]).score == 0


def sequential_children(rows, slack=1.02):
    """Rows that say 其中 never stay; with an amount they open a run under the last row that stayed."""
    kept, last, run, names = [], None, None, set()
    for _, name, amount in rows:
        if name.startswith("其中"):
            run = [last, amount] if last and amount is not None else None
        elif amount is None:
            continue
        elif run and run[1] + amount <= run[0] * slack:
            run[1] += amount
        else:
            run = None
            if name not in names:
                names.add(name)
                kept.append(name)
                last = amount
    return kept


def sequential_parents(rows):
    kept, i = [], 0
    while i < len(rows):
        x, total, found = rows[i][2], 0.0, 0
        if x > 0:
            for j in range(i + 1, len(rows)):
                if total > x * 1.01:
                    break
                total += rows[j][2]
                if j - i >= 2 and x * 0.99 <= total <= x * 1.01:
                    found = j - i
                    break
        if found:
            kept += [n for _, n, _ in rows[i + 1 : i + 1 + found]]
            i += 1 + found
        else:
            kept.append(rows[i][1])
            i += 1
    return kept


def test_folds_equal_the_sequential_rules(spark):
    r = random.Random(11)
    cases, rows = {}, []
    for k in range(120):
        case, at = [], 0
        for _ in range(r.randrange(1, 9)):
            v = float(r.choice([100, 60, 40, 30, 70, 10, 50]))
            case.append((at, ("其中：" if r.random() < 0.2 else "") + f"n{at}", v))
            at += 1
        cases[k] = case
        rows += [("1", 2024, k, i, "d", n, v) for i, n, v in case]
    items = spark.createDataFrame(rows, "code string, year int, table_id int, r int, dim string, name string, amount double")

    def got(df):
        out = {}
        for x in df.orderBy("table_id", "r").collect():
            out.setdefault(x.table_id, []).append(x.name)
        return out

    assert got(G.without_children(items)) == {k: n for k, c in cases.items() if (n := sequential_children(c))}
    assert got(G.without_parents(items)) == {k: n for k, c in cases.items() if (n := sequential_parents(c))}


def test_units_of_all_spellings(spark):
    df = spark.createDataFrame([(f"{a}单位：{p}{u}{b}", f) for a, b in (("（", "）"), ("(", ")"), ("", " x")) for p in ("", "人民币") for u, f in (("元", 1), ("千元", 1000), ("万元", 10000), ("百万元", 10**6), ("亿元", 10**8))], "t string, f int")
    assert df.where(T.detect_unit(F.col("t")) != F.col("f")).count() == 0


def test_triage_reopens(spark):
    log = [(1, "2024-01-01", "1", "red", "open"), (2, "2024-01-02", "1", "red", "resolved"), (3, "2024-01-03", "1", "orange", "open"), (4, "2024-01-04", "2", "red", "ok")]
    df = spark.createDataFrame(log, "seq int, ts string, code string, reason string, status string")
    got = {r.code: (r.reason, r.status, r.created_at, r.n_events) for r in L.triage_state(df, ("code",)).collect()}
    assert got == {"1": ("orange", "open", "2024-01-01", 3), "2": ("red", "ok", "2024-01-04", 1)}


def test_table_cache(spark, tmp_path):
    tables = [{"page": 20, "table": COMPOSITION, "section": "management"}, {"page": 400, "table": MARGIN}]
    (tmp_path / "000001_2024_h.json").write_text(json.dumps(tables, ensure_ascii=False))
    (tmp_path / "000002_2024.json").write_text("not json")
    (tmp_path / "000003_2024.json").write_text("[]")
    spark.dataSource.register(table_cache.TableCache)
    for df in (spark.read.format("table_cache").load(str(tmp_path)), table_cache.scan(spark, str(tmp_path))):
        (row,) = df.collect()
        assert (row.code, row.year, row.page, row.section, row.grid[1][0]) == ("000001", 2024, 20, "management", "工业")
    wanted = spark.createDataFrame([(f"00000{i}", 2024) for i in range(1, 5)], "code string, year int")
    missing = table_cache.misses(wanted, table_cache.scan(spark, str(tmp_path)))
    assert sorted(r.code for r in missing.collect()) == ["000002", "000003", "000004"]  # an empty list is a miss
    # without sections the first pages aren't scanned; in sections that hold no tables nothing is
    assert [r[3] for r in table_cache.rows_of("1_2024", json.dumps([{"page": p} for p in (3, 16, 350, 351)]).encode())] == [16, 350]
    assert [r[3] for r in table_cache.rows_of("1_2024", json.dumps([{"page": 3, "section": "gov"}, {"page": 20, "section": "toc"}]).encode())] == [3]


def test_progress_lines_and_test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("1", 2024, "ok"), ("2", 2024, "error")], "code string, year int, status string")
    folder = f"file://{tmp_path}/progress"
    L.append_lines(rows.limit(1), folder)
    L.append_lines(rows.where("code = '2'"), folder)
    (tmp_path / "progress" / "part-x.txt").write_text('{"code":"3","ye\n[1]\n')
    lines = spark.read.text(folder).withColumnRenamed("value", "line")
    good, dead = L.read_lines(lines, "code string, year int, status string")
    assert sorted(tuple(r) for r in good.collect()) == [("1", 2024, "ok"), ("2", 2024, "error")] and dead.count() == 2
    rows.write.parquet(f"{tmp_path}/real")
    assert L.ensure_copy(f"{tmp_path}/real", f"{tmp_path}/test", spark) and not L.ensure_copy(f"{tmp_path}/real", f"{tmp_path}/test", spark)
    assert spark.read.parquet(f"{tmp_path}/test").count() == 2
    with pytest.raises(ValueError):
        L.ensure_copy(f"{tmp_path}/real", f"{tmp_path}/real/", spark)


def test_plugin_failures_become_rows(spark):
    @plugins.plugin("broken")
    def broken(tables):
        raise KeyError("nothing here")

    cells = grid_cells(spark, [["a", "1"], ["b", "2"], ["c", "3"]])
    assert [r.amount for r in plugins.run(cells, "first_numbers").orderBy("idx").collect()] == [1.0, 2.0, 3.0]


def test_streams_equal_their_batch_twins(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "events")
    events.repartition(3).write.parquet(src)
    q = live.progress(live.event_stream(spark, src)).writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.outcome, r.n, r.last_id) for r in spark.table("progress").collect()}
    assert got == {(r.event_type, r.n, r.last_id) for r in events.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id")).collect()}
    live.append_events(live.event_stream(spark, src), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_vectors_and_templates(spark):
    from tablewright.functions.embedding import model_vector, ngram_vector
    from tablewright.operators.verdicts import RuleVerdicts, TableVerdicts

    df = spark.createDataFrame([(1, "营业收入构成"), (2, "营业收入"), (3, "x"), (4, None)], "id int, t string")
    v = {r.id: r.v for r in df.select("id", ngram_vector(F.col("t")).alias("v")).collect()}
    assert abs(sum(x * x for x in v[1]) - 1) < 1e-5 and sum(v[3]) == sum(v[4]) == 0
    assert sum(a * b for a, b in zip(v[1], v[2], strict=True)) > 0.5
    m = df.select("id", model_vector(lambda: lambda texts: [[float(len(t))] for t in texts])("t").alias("v"))
    assert {r.id: r.v for r in m.collect()} == {1: [6.0], 2: [4.0], 3: [1.0], 4: [0.0]}
    assert df.where("id = 4").select(T.render("{{id}}/{{t}}/{{no}}", {"id": F.col("id"), "t": F.col("t")}).alias("x")).first().x == "4//{{no}}"
    records = spark.createDataFrame([("1", 2024, "f", "high"), ("2", 2024, "f", "low")], "code string, year int, field string, confidence string")
    judged = RuleVerdicts().judge(records)
    assert {r.code: r.verdict for r in judged.collect()} == {"1": "pass", "2": "hold"}
    assert TableVerdicts(judged).judge(records.where("code = '1'")).count() == 1
