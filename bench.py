"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names instead of the headline list).
"""

from __future__ import annotations

import json
import os
import sys
import time

from structaudit.plans import registry
from structaudit.session import local_session

HEADLINE = (
    "name_first_by_truth", "recognition_status", "agreement_candidates", "policy_cards", "scorecard", "annotator_stats",
    "calibration", "collusion", "document_summary", "candidate_names", "page_references", "dictionary_hits",
    "resolved_names", "fuzzy_labels", "service_verdicts", "page_figures", "drawing_regions",
)


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    return 0


if __name__ == "__main__":
    sys.exit(main())
