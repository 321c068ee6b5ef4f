"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS], full results to a noop sink; one JSON line.

The stored views that the queries read are part of the total: "bridge" is the time to write all of them.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
HEADLINE = ("q_revenue_breakdown", "q_plausibility", "q_success_rate", "q_hard_rules", "q_score_a", "q_leaderboard", "q_col_types", "q_anchor_col", "q_signature_rank", "q_select_table", "q_vector_recall", "q_stitch_islands", "q_latest_runs", "q_timeline", "q_amortization", "q_fingerprint", "q_confusion", "q_best_source")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    from tablewright.plans import base
    from tablewright.plans.registry import QUERIES
    from tablewright.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", **{"spark.ui.showConsoleProgress": "false"})
    spark.read.parquet(f"{sf}/region.parquet").write.format("noop").mode("overwrite").save()  # the session's own start
    began = time.time()
    for name in base.STORED:
        base.view(spark, sf, name)
    took = {"bridge": round(time.time() - began, 3)}
    for name in HEADLINE:
        each = []
        for _ in range(runs):
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            each.append(time.time() - began)
        took[name] = round(statistics.median(each), 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rpartition("sf")[2]}))
    base.forget(spark, sf)
    spark.stop()


if __name__ == "__main__":
    main()
