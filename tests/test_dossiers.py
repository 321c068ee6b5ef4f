"""Failures by layer, outcomes of fields and their rates."""

from tablewright.operators import dossiers as D
from tests.test_parsing import COMPOSITION, STAFF, cells_of


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_extraction_needs_rows_of_data(spark):
    """Three rows with a digit and a text, in a table that has a marker."""
    three = COMPOSITION + [["产品C", "5", ""]]
    cells = cells_of(spark, {("a", 2020, 1): three, ("a", 2020, 2): STAFF, ("b", 2020, 1): COMPOSITION, ("c", 2020, 1): STAFF, ("d", 2020, 1): [["分地区", None], ["1", "2"], ["国内", ""], [None, None]]})
    got = {r.code: (r.n_marked, r.extracted) for r in D.extraction_probe(cells).collect()}
    assert got == {"a": (1, True), "b": (1, False), "d": (1, False)}


def test_parse_counts_dimensions_that_meet_an_anchor(spark):
    items = frame(spark, "code string, year int, dim string, amount double", [("a", 2020, "segments", 600.0), ("a", 2020, "segments", 400.0), ("a", 2020, "regions", 500.0), ("b", 2020, "segments", 7.0), ("c", 2020, None, None), ("d", 2020, "regions", None)])
    anchors = frame(spark, "code string, year int, revenue double, main_revenue double", [("a", 2020, 1000.0, 490.0), ("d", 2020, 1.0, None)])
    assert {r.code: (r.n_dims, r.n_hit) for r in D.parse_probe(items, anchors).collect()} == {"a": (2, 2), "b": (1, 0), "d": (1, 0)}


def test_the_first_layer_that_gives_way(spark):
    failed = frame(spark, "code string, year int", [(c, 2020) for c in "abcdef"])
    chosen = frame(spark, "code string, year int, table_id int, rel double, via string", [(c, 2020, 1, 0.4 if c == "c" else None if c == "b" else 0.01, "nearest") for c in "abcde"])
    extraction = frame(spark, "code string, year int, n_marked bigint, extracted boolean", [("a", 2020, 1, False)] + [(c, 2020, 2, True) for c in "bcde"])
    parsed = frame(spark, "code string, year int, n_dims bigint, n_hit bigint", [("c", 2020, 1, 0), ("d", 2020, 2, 1), ("e", 2020, 2, 2)])
    anchors = frame(spark, "code string, year int, revenue double", [(c, 2020, 0.0 if c == "b" else 10.0) for c in "abcdef"])
    got = {r.code: (r.layer, r.anchor_matches, r.n_marked) for r in D.dossiers(failed, chosen, extraction, parsed, anchors).collect()}
    assert got == {"a": ("extraction", True, 1), "b": ("anchor", False, 2), "c": ("selection", False, 2), "d": ("parse", True, 2), "e": ("data", True, 2), "f": ("extraction", False, 0)}
    assert D.dossiers(failed.limit(0), chosen, extraction, parsed, anchors).count() == 0


JUDGED = "field string, source string, ord int, code string, year int, n_rows bigint, n_dims bigint, ok_dims bigint, confidence string, clean boolean"


def test_outcomes_and_rates(spark):
    reports = frame(spark, "code string, year int", [(c, 2020) for c in "abcdefgh"])
    rows = [("revenue_breakdown", "default", 0, c, 2020, 3, 1, 1, "high", True) for c in "abch"]
    rows += [("revenue_breakdown", "default", 0, "d", 2020, 3, 1, 0, "low", False), ("revenue_breakdown", "buckets", 1, "d", 2020, 3, 1, 0, "low", False), ("revenue_breakdown", "default", 0, "e", 2020, 3, 1, 0, "low", False), ("revenue_breakdown", "default", 0, "f", 2020, 3, 1, 0, "unknown", False)]
    verdicts = frame(spark, "code string, year int, verdict string", [("b", 2020, "pass"), ("c", 2020, "hold"), ("d", 2020, "wrong_table"), ("g", 2020, "pass")])
    names = frame(spark, "code string, year int, name string", [("h", 2020, "某银行"), ("a", 2020, None)])
    out = D.outcomes(reports, frame(spark, JUDGED, rows), verdicts, names)
    got = {r.code: r.outcome for r in out.where("field = 'revenue_breakdown'").collect()}
    assert got == {"a": "green", "b": "committed", "c": "verify_hold", "d": "no_such_table", "e": "non_green", "f": "no_anchor", "g": "no_data", "h": "out_of_scope"}
    assert {r.outcome for r in out.where("field = 'employees'").collect()} == {"no_data"}
    r = {x.field: x for x in D.rates(out).collect()}
    assert (r["revenue_breakdown"].anchored_denominator, r["revenue_breakdown"].success_rate) == (5, 0.4)
    assert (r["overall"].anchored_denominator, r["overall"].success_rate, r["overall"].no_data) == (29, 0.069, 25)
    assert r["employees"].success_rate == 0


def test_rates_without_rows(spark):
    none = D.rates(frame(spark, "field string, outcome string", [])).collect()
    assert [(r.field, r.anchored_denominator, r.success_rate) for r in none] in ([], [("overall", 0, None)])
    only = D.rates(frame(spark, "field string, outcome string", [("x", "no_anchor")])).where("field = 'x'").first()
    assert (only.no_anchor, only.anchored_denominator, only.success_rate) == (1, 0, None)
