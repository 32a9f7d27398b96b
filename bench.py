"""Time the headline queries and print one JSON line.

Each query runs in full (every result column is computed and discarded) after one small warm-up job.
"""

from __future__ import annotations

import json
import os
import time

from trailhead.plans import catalog
from trailhead.session import build_session

HEADLINE = [
    "a8_dedupe_content", "b6_tokens", "b13_chunk_files", "c4_dependency_edges", "c5_expand_neighbors", "c6_impact",
    "d7_rank_authority", "d8_glob_join", "e2_score", "e5_search", "e10_diff_chunks", "f1_rank_documents", "f2_rank_files",
    "f2_rank_files_hybrid", "f7_related_tests", "g2_attribute", "g5_evaluate", "g9_tune", "h2_op_summary", "h12_diff_stats",
    "i4_validate_events", "i5_ingest_results",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "trailhead-bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
