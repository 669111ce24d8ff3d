"""Time the headline queries and print one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from antecede.checks import load
from antecede.session import local_session

HEADLINE = (
    "a10_dataset_manifest", "d2_country_nodes", "d3_e3_country_pairs", "d7_country_profiles",
    "e1_trailing_in_degree", "d9_in_degree_histogram", "c3_precursor_links", "k3_causal_filter",
    "c5_usual_causes", "d12_type_pair_matrix", "k1_score_causes", "g6_url_queue",
    "h25_page_gate", "i1_near_duplicate_groups", "i2_bm25_scores", "d23_d24_agreement",
    "j7_j8_chains", "b17_c19_claim_edges", "d28_d29_retrieval_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    checks = load()
    spark.read.parquet(f"{folder}/events.parquet").count()  # start the executors
    times = {}
    for name in HEADLINE:
        start = time.time()
        checks[name][0](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
