"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR   test set, default /root/testdata/sf0.1
    BENCH_CPUS     local cores, default 8
    BENCH_QUERIES  comma-separated names, default the headline set
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from prospectra.queries import QUERIES  # noqa: E402
from prospectra.session import build_session  # noqa: E402

HEADLINE = ("target_accounts", "feature_table", "missing_counts", "describe_numeric", "histogram", "correlation",
            "boxplot_stats_doubles", "target_rate", "average_precision", "split_exact", "explanations", "prospects",
            "train_and_select", "score_batch")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
