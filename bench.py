"""Time the headline queries once each and print one JSON line."""
from __future__ import annotations

import json
import os
import time

from maskfold.plans.workload import QUERIES
from maskfold.session import local_session

HEADLINE = os.environ.get("BENCH_ONLY", "").split() or [
    "j6_iou_pairs", "j7_match_greedy", "w1_pick_threshold", "j10_mask_nms", "p10_fp_category", "a39_average_precision",
    "j18_pixel_confusion", "a2_pixel_coverage", "a5_micro_macro", "c1_components_8", "a24_region_confidence", "a20_prob_stats",
    "a16_threshold_sweep_px", "h4_hann_blend", "h8_polygon_to_runs", "h17_co2", "j2_lookup_fallback", "j13_near_counts",
    "j14_hamming_pairs", "j17_neighbour_count", "g1_locked_split", "g3_group_split", "a29_feature_auc", "s8_history_current",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
