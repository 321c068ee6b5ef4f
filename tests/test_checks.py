"""Checks of whole results, known fixes and candidate rules on small inputs."""

import pytest

from tablewright.operators import checks, experience

REPORTS = [("a", 1), ("b", 1), ("c", 1)]


@pytest.fixture
def reports(spark):
    return spark.createDataFrame(REPORTS, "code string, year int")


def told(df):
    return sorted((r.code, r.field, r.status) for r in df.collect())


def test_revenue_checks(spark, reports):
    items = spark.createDataFrame(
        [("a", 1, "segments", "x", 60.0), ("a", 1, "segments", "y", 19.9), ("a", 1, "industries", "z", None), ("b", 1, "segments", "x", 120.0), ("b", 1, "regions", "n", 50.0), ("b", 1, "regions", "m", 50.0), ("b", 1, "by_channel", "q", 500.0)],
        "code string, year int, dim string, name string, ratio double",
    )
    r = "revenue_breakdown"
    want = [("a", f"{r}.regions", "EMPTY"), ("a", f"{r}.segments", "SUSPICIOUS"), ("b", f"{r}.industries", "EMPTY"), ("b", f"{r}.segments.x", "ERROR"), ("c", r, "MISSING")]
    assert told(checks.revenue(reports, items)) == want
    assert checks.revenue(reports.limit(0), items.limit(0)).count() == 0


def test_rnd_checks(spark, reports):
    items = spark.createDataFrame([("a", 1, 50.0), ("a", 1, 30.0), ("a", 1, 16.0), *[("b", 1, None)] * 21], "code string, year int, amount double")
    totals = spark.createDataFrame([("a", 1, 100.0), ("b", 1, 0.0)], "code string, year int, total double")
    assert told(checks.rnd(reports, items, totals)) == [("a", "rnd_info.detail_count", "PASS"), ("a", "rnd_info.total_this", "PASS"), ("b", "rnd_info.detail_count", "SUSPICIOUS"), ("c", "rnd_info", "MISSING")]


def test_head_and_partner_checks(spark, reports):
    items = spark.createDataFrame([("a", 1, "composition", 95), ("a", 1, "education", 50), ("b", 1, "composition", 5)], "code string, year int, dim string, n int")
    totals = spark.createDataFrame([("a", 1, 100), ("b", 1, 100), ("c", 1, 0)], "code string, year int, total int")
    assert told(checks.employees(reports, items, totals)) == [("a", "employees.composition", "PASS"), ("a", "employees.education", "SUSPICIOUS"), ("b", "employees.composition", "SUSPICIOUS"), ("c", "employees", "MISSING")]
    rows = "code string, year int, dim string, ratio double"
    clients = spark.createDataFrame([("a", 1, "client", 20.0), ("a", 1, "client", None), ("a", 1, "total", 21.0), ("b", 1, "client", 5.0)], rows)
    suppliers = spark.createDataFrame([("a", 1, "supplier", 1.0), ("b", 1, "total", 9.0)], rows)
    issues = checks.partners(reports, clients, suppliers)
    assert told(issues) == [("b", "top_clients", "SUSPICIOUS"), ("b", "top_suppliers", "MISSING"), ("c", "top_clients", "MISSING"), ("c", "top_suppliers", "MISSING")]
    assert sorted((r.code, r.total_checks, r.n_missing, r.n_suspicious) for r in checks.summary(issues).collect()) == [("b", 2, 1, 1), ("c", 2, 2, 0)]


def test_known_fixes(spark):
    fixes = spark.createDataFrame([(1, "a", "f", "p"), (2, "a", "f", "q"), (3, "a", "f", "q"), (4, "b", "f", "q"), (5, "b", "g", "r")], "id int, code string, field string, fix string")
    known = experience.recorded(fixes)
    cases = spark.createDataFrame([("a", "f"), ("c", "f"), ("c", "g"), ("c", "h")], "code string, field string")
    assert sorted(map(tuple, experience.known_fix(cases, known).collect()), key=str) == [("a", "f", "p", "exact"), ("c", "f", "q", "field"), ("c", "g", "r", "field"), ("c", "h", None, None)]
    assert [tuple(r) for r in experience.top_fixes(known).collect()] == [(1, "a", "f", "q", 2)]


def test_candidates(spark):
    kind = "code string, candidate int, passed boolean, red_count int, red_fields array<string>"
    before = spark.createDataFrame([("a", 0, False, 3, ["x", "y"]), ("b", 0, True, 0, []), ("c", 0, False, 2, ["x"])], kind)
    after = spark.createDataFrame(
        [("a", 1, False, 2, ["x"]), ("a", 2, False, 1, ["z"]), ("a", 3, False, 1, ["y"]), ("a", 4, False, 1, ["x"]), ("a", 5, False, 3, ["x"]), ("b", 1, False, 1, ["x"]), ("b", 2, True, 0, []), ("c", 1, True, 2, [])], kind
    )
    judged = experience.accepted(before, after)
    assert sorted((r.code, r.candidate) for r in judged.where("outcome = 'accept'").collect()) == [("a", 1), ("a", 3), ("a", 4), ("c", 1)]
    assert sorted(map(tuple, experience.best_candidate(judged).collect())) == [("a", 5, True, 3), ("b", 2, False, None), ("c", 1, True, 1)]
