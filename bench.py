"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query's whole result goes to the ``noop`` sink. Each query runs twice and the second time counts, so
that code generation and file caches do not weigh in.
"""

from __future__ import annotations

import json
import logging
import os
import sys
import time

from defectlake import catalog
from defectlake.session import local_session

HEADLINE = (
    "issue_table", "dedupe_findings", "mark_duplicates", "prioritise", "scan_stats", "diff_scans",
    "relate_findings", "match_cve", "correlate_exploitability", "ingest_memcheck",
    "ingest_sanitizer", "ingest_infer", "ingest_reports", "ingest_heap_sites", "alloc_blocks",
    "heap_profile", "heap_running", "flame_layers", "allocation_by_line", "attach_source_context",
    "extract_functions", "flow_calls", "dataflow_edges", "scan_c_rules", "classify_lines",
    "leak_feasibility", "locate_fix", "propagate_taint", "reachability_closure", "export_sarif",
    "stream_scan_stats", "live_objects", "stream_live_objects", "stream_findings",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    logging.disable(logging.CRITICAL)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench", memory="16g")
    registered = catalog.queries()
    seconds: dict[str, float] = {}

    def run(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in names:
        run(name)
        seconds[name] = round(run(name), 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
