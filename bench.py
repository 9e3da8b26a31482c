"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced with the ``noop`` writer (full execution, nothing
collected), after one warm-up pass; the figure per query is the median of
three runs. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "run_pipeline",          # flagship: score -> products -> quadrants -> ranking
    "score_reviews",         # review-level scoring over the whole view
    "product_metrics",
    "classify_quadrants",
    "make_decisions",        # classic path with its five quantiles
    "run_service",
    "issue_breakdown",
    "summary_stats",
    "dashboard_records",
    "enrich_products",
    "robust_preprocess",
    "apply_ml_predictions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    os.environ.setdefault("BENCH_CPUS", str(cpus))

    from revlens.plans.queries import QUERIES
    from revlens.session import local_test_session

    spark = local_test_session(cpus)

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    out = {}
    for name in HEADLINE:
        run(name)  # warm-up (JIT, file listing, broadcast sizing)
        out[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "sum_of_median_query_seconds", "value": round(sum(out.values()), 3),
        "unit": "sec", "queries": out, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus, "runs": runs, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
