"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from metaloom.plans import all_queries  # noqa: E402
from metaloom.session import local_session  # noqa: E402

HEADLINES = (
    "tokenize_tf", "bm25_topk", "hybrid_search_topk", "baseline_lexical_topk", "bounded_candidates", "bm25_multi_query", "element_search", "exact_name_match",
    "scalar_fusion_winner", "scalar_fusion_conflicts", "reference_resolution", "graph_impact", "bundle_completion", "hierarchy_closure", "aggregate_pages",
    "branch_ranking", "coverage_assess", "identity_binding", "feature_neighbors", "similarity_link_topk", "association_report", "eval_micro_prf",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    wanted = sys.argv[1:] or HEADLINES
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the executors
    times = {}
    for name in wanted:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
