"""Queries against their SQL in DuckDB on the smallest data, and what holds for all of them."""

import os

import duckdb
import pytest

from tablewright.plans.base import TABLES
from tablewright.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: No SQL: plug-ins in Python, arrays as results.
ROWS_ONLY = {"q_field_chain", "q_version_parsers"}
FAST = ["q_revenue_breakdown", "q_plausibility", "q_success_rate", "q_plaus_b", "q_plaus_c", "q_hard_rnd", "q_parse_money", "q_parse_ratio", "q_cell_types", "q_unit_detect", "q_unit_bank", "q_compare_value", "q_best_version", "q_score_b", "q_section_fill", "q_toc_asof", "q_fingerprint", "q_amortization", "q_stitch_islands", "q_patch_page", "q_triage_state", "q_timeline", "q_upsert_keep", "q_vector_recall", "q_top_rows", "q_main_business", "q_missing_dims", "q_rule_merge", "q_child_runs", "q_fold_nested", "q_cost_breakdown", "q_rnd_items", "q_employees", "q_top_clients", "q_provenance", "q_signature_rank", "q_select_table", "q_scan_tables", "q_heal_cascade", "q_resume", "q_route_field", "q_add_marker", "q_v_costs", "q_v_staff", "q_v_rnd", "q_v_clients", "q_v_suppliers", "q_v_buckets", "q_v_two_years", "q_continued", "q_page_merged", "q_extract_heal", "q_recode", "q_full_pass", "q_parse_status", "q_over_anchor", "q_isolated_plugins", "q_cell_boxes", "q_prov_vote_boxes", "q_vector_index", "q_semantic_check", "q_batch_run", "q_anchor_filled", "q_text_checks", "q_neighbor_lines", "q_next_content", "q_profile_applied", "q_result_checks", "q_best_candidate", "q_known_fix", "q_bank_breakdown", "q_bank_columns", "q_bank_units", "q_select_fields", "q_recall_trace", "q_select_trace", "q_field_agreement", "q_dossier", "q_field_rates", "q_rnd_pick"]


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert len(QUERIES) >= 170


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", FAST)
def test_same_as_duckdb(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall()), key=str)
    assert got


def test_entry(spark):
    import __spark_entry__

    rows = {r.field: r for r in __spark_entry__.entry(spark).collect()}
    assert (rows["overall"].green, rows["overall"].anchored_denominator, rows["overall"].success_rate) == (38, 63, 0.603)


def test_no_python_in_the_benchmarked_plans(spark):
    import bench

    for name in ("q_plausibility", "q_score_a", "q_signature_rank", "q_timeline"):
        assert name in bench.HEADLINE
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
