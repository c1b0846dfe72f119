"""Headline queries at one scale; prints a single JSON line."""
from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import Inputs, QUERIES, run_analysis  # noqa: E402
from tremorline.session import build_session  # noqa: E402

HEADLINE = [
    "commit_file_rows", "top_bugfix_files", "churn_features", "authorship_features", "top_partners",
    "coupling_features", "complexity_features", "matrix_from_history", "evaluate_model", "rank_files",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cores}]", **{
        "spark.sql.shuffle.partitions": cores, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}

    def timed(name, build):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)

    QUERIES["history_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, sf_dir))
    timed("rank_risk", lambda: run_analysis(Inputs(spark, sf_dir)).ranked)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name,
    }))


if __name__ == "__main__":
    main()
