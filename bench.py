"""Headline queries on one machine; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.
"""

from __future__ import annotations

import json
import logging
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from veilgauge.session import local_session  # noqa: E402
from workbook.queries import registry  # noqa: E402

HEADLINE = [
    # profile and analyse
    "profile_columns", "equivalence_classes", "k_anonymity", "class_size_per_row", "l_diversity",
    "vulnerable_clusters", "duplicate_flags", "iqr_fences", "correlation_pairs", "latest_per_key",
    # attack
    "linkage_matches", "linkage_crowded", "linkage_dates_numbers", "linkable_overlap", "risk_score",
    # mitigate and retest
    "apply_mitigations", "optimize_mitigations", "before_after",
    # quality and readiness
    "quality_issues", "ml_findings", "data_health",
]
REPEATS = 2


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    # Linkage tells how many pairs it compared.
    logging.basicConfig(stream=sys.stderr, level=logging.WARNING, format="%(message)s")
    logging.getLogger("veilgauge").setLevel(logging.INFO)
    spark = local_session(cores=cores, memory=os.environ.get("BENCH_MEMORY", "12g"), name="bench")
    queries = registry()
    queries["scan_parquet"](spark, directory).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(REPEATS):
            start = time.perf_counter()
            # Writing to nowhere computes every row without collecting any.
            queries[name](spark, directory).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            best = spent if best is None else min(best, spent)
        seconds[name] = round(best, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
