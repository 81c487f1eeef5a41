"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``: warm, median of three.

Prints one JSON line. Every result is materialised in full (noop sink).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = (
    "j4_images_by_tag", "j10_post_previews", "k3_suggest_tags", "k6_suggest", "v1_knn", "v9_knn_join", "v9_knn_all_rows",
    "v8_ann_knn", "m2_merge_images", "m3_merge_links", "h6_meter_solvent", "h6_meter", "h11_meter_all_operations",
    "r2_random_posts", "j16_policy_asof", "b1_match_transfers", "a15_phase_occupancy", "a11_daily_usage", "p7_convert_objects",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from checks import QUERIES
    from lumicat.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
        # the test files are small: split them down to their row groups
        "spark.sql.files.openCostInBytes": "524288",
    })
    spark.sparkContext.setLogLevel("ERROR")
    names = [a for a in sys.argv[1:]] or HEADLINE
    spent = {}
    for name in names:
        times = []
        for _ in range(runs + 1):  # the first run warms up
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        spent[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(spent.values()), 3), "unit": "sec",
        "queries": spent, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus), "runs": runs,
    }))


if __name__ == "__main__":
    main()
