"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from meetlake.plans.queries import PLANS  # noqa: E402
from meetlake.session import build_session  # noqa: E402

HEADLINE = (
    "athlete_year", "temporal_features", "supervised_temporal", "history_examples", "leakage_audit",
    "profile", "integrity_issues", "deduplicated", "resolve_groups", "apply_resolution", "describe",
    "latest_record", "leaderboard", "podium_threshold", "attempt_plan",
    "content_class", "format_profile", "canonical_results",
    "error_percentiles", "user_rank", "competitors", "class_comparison",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("meetlake-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    # start the engine and touch the files, so that the first query is not charged for it
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        start = time.perf_counter()
        PLANS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
