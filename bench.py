"""Times the headline queries; prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
    BENCH_RUNS (default 3: the median of that many warm runs is reported)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "bm25_topk", "bm25_match_all", "two_list_rrf_titles", "compliance_report", "text_vector_topk", "vector_topk", "bm25_fused_topk", "simple_retrieval",
    "graph_boost", "question_concepts", "concept_references", "article_split", "window_chunks",
    "cited_references", "authority", "definition_sources", "title_relations", "most_referenced", "theme_cooccurrence",
    "price_quantiles", "log_by_branch", "index_diff", "upsert_articles", "grounded_in_corpus", "evaluation_rollup",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE

    from lexmesh.plans import catalogue
    from lexmesh.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus), memory="16g")
    plans = catalogue.plans()
    seconds: dict[str, float] = {}
    for name in names:
        took = []
        for _ in range(runs + 1):  # the first run warms up and is not counted
            start = time.perf_counter()
            plans[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took[1:] or took), 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    questions = spark.read.parquet(f"{folder}/benchmark.parquet").count()
    out = {
        "metric": "total_warm_median_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rstrip("/").split("sf")[-1],
    }
    if "bm25_fused_topk" in seconds:
        out["hybrid_questions_per_second"] = round(questions / seconds["bm25_fused_topk"], 2)
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
