"""Seconds per headline query on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line.

``stage_*`` entries build the shared preparation stages once (panel, labels, forecasts, training
cells, episodes); the queries after them read those tables, like a cluster run would.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "s2_pruned_scan", "s5_table_fingerprint", "p1_coerce_numbers", "p13_origin_calendar", "j1_family_outer_join",
    "j2_grid_completion", "j4_supervised_cells", "j8_event_context", "j9_next_event_within", "j10_outside_event_padding",
    "j11_matched_controls", "j12_event_window_outcomes", "j13_alert_detection", "j14_diverse_nearest_neighbors",
    "m7_analog_forecast", "t3_diverse_top_k", "e1_lags", "e2_rolling_min_fraction", "e3_rolling_sample_std",
    "e7_bounded_forward_fill", "e11_volatility_and_baseline", "e12_low_level_ratio", "e13_episodes", "e15_boundary_pressure",
    "e16_point_labels", "e18_sequence_windows", "e22_overlap_reconciliation", "e17_naive_forecasts_scored", "a4_scope_rollup",
    "a6_column_profile", "a7_outlier_candidates", "a9_time_grid_audit", "a12_support_shift", "a13_calendar_profile",
    "a16_optimal_scale", "a18_spearman", "a19_rank_auc", "a21_outcome_discrimination", "a25_pressure_relation",
    "a26_binary_scores", "a38_promotion_gate", "h6_soft_gate", "b7_two_block_transfer", "k2_result_contract",
    "k5_future_perturbation", "m3_ols_per_horizon", "m3_median_filled_ols", "m5_weighted_l1_proxy", "m6_logistic_hazard",
    "m9_recursive_rollout", "m2_shared_horizon_trees", "r1_stream_interval_means",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tidegrid.plans import base, catalog, events_base, models
    from tidegrid.session import build_session

    spark = build_session(cpus, "tidegrid-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}

    def timed(name: str, job) -> None:
        start = time.perf_counter()
        job()
        times[name] = round(time.perf_counter() - start, 3)

    for name, build in (("stage_panel", base.panel), ("stage_users", base.users), ("stage_labels", base.labels),
                        ("stage_forecasts", base.forecasts), ("stage_training_cells", models.cells),
                        ("stage_episodes", events_base.episodes)):
        timed(name, lambda: build(spark, sf_dir))
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    for name in chosen:
        timed(name, lambda: run(catalog.QUERIES[name].frame(spark, sf_dir)))
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
