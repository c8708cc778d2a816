"""Times the headline queries; prints one JSON line. $BENCH_SF_DIR and $BENCH_CPUS choose data and cores.

Figures to compare with are those of a running server, so the dashboard queries are run once before they are timed, and the rollup
tiers, which a server keeps, are built by a query of their own. The pipeline queries (pN_) are timed at their first run.
"""

from __future__ import annotations

import importlib.util
import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from tidewater.session import local_session

HEADLINE = [
    "throughput_bucket", "throughput_by_dim", "error_rate_filter", "pctl_bucket", "topk_groups", "log_list_topk", "point_lookup", "count_all", "dcount_exact", "dcount_sketch",
    "self_join_edges", "pricing_summary", "join_inner", "moving_avg", "mor_resolve", "json_arrow", "text_match", "rollup_1m", "rollup_store", "rollup_routed", "rollup_hybrid", "rollup_sql",
    "p1_found", "p2_percentiles", "p3_found", "p4_found", "p5_distinct", "p6_found", "p7_found", "p8_ids", "p9_containers", "p10_found",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cpus=cpus, partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spec = importlib.util.spec_from_file_location("__spark_entry__", f"{ROOT}/__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    queries = entry.queries()
    queries["count_all"](spark, folder).write.format("noop").mode("overwrite").save()  # the session starts
    times = {}
    for name in HEADLINE:
        if name in queries:
            if not name.startswith("p") or not name[1].isdigit():
                queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
