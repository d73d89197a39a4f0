"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from cladewise.plans import registry
from cladewise.session import local_session

HEADLINE = ["l5_present_loglik", "l13_tree_loglik", "l13_batched_trees", "a3_burden", "f16_snvs_branching", "g20_reassigned_snvs", "g17_bad_snvs", "a13_pair_counts", "h6_viterbi_path", "j5_distances"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    registry.queries()["a2_counts_by_cell"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
