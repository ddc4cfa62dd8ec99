"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
local cores. Every query is run to completion into a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fieldscan.plans import registry  # noqa: E402
from fieldscan.session import build_session  # noqa: E402

HEADLINE = [
    "risk_class_shares", "pixel_indices", "midrank_percentiles", "robust_statistics", "risk_groups", "membership_digest",
    "daily_mosaic", "vegetation_statistics", "daily_observations", "latest_versions",
    "theil_sen_trend", "tile_trends", "nearest_acquisition", "baseline_comparison", "fused_decisions",
    "band_group_profiles", "spaced_contrast_regions", "anomaly_scores", "points_in_areas", "availability_conflicts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
