"""Headline queries on one machine; prints one JSON line.

Each query is run once after a warm-up of the session and forced with a noop
write, so the whole result is computed and nothing is collected.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from etholith.plans import catalog  # noqa: E402
from etholith.session import get_spark  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "bout_totals",
    "bout_summary",
    "bins_total",
    "animal_rollup",
    "build_image_table",
    "behaviour_report",
    "rank_sum",
    "spearman",
    "p_adjust_holm",
    "key_stats",
    "bootstrap_replicates",
    "radius_count",
    "match_candidates",
    "colocalisation_counts",
    "rotation_null",
    "priority_merge",
    "gaps",
    "interpolate_gaps",
    "carry_forward_seed",
    "mask_iou",
    "assign_single",
    "assign_frames",
    "skeleton_violation",
    "anatomical_swap",
    "mask_cleanup",
    "toggle_range_swap",
    "repair_tracks",
    "wide_keypoints",
)


def main() -> None:
    shared = tempfile.mkdtemp(prefix="bench-")
    atexit.register(shutil.rmtree, shared, ignore_errors=True)
    spark = get_spark(
        "bench",
        master=f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": shared,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    catalog.QUERIES["marker_counts"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{times[name]:8.2f}s {name}", file=sys.stderr, flush=True)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
