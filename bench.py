"""Timings of headline queries: one JSON line. Each query runs twice into a sink that keeps nothing; the
faster run counts."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "quality_by_language", "clean_documents", "cleaning_stats", "model_input_qa", "low_quality_score",
    "fallback_rule_score", "keyword_hits_by_platform", "dedup_first", "anti_existing", "latest_by_key",
    "knn_join", "knn_join_cells", "hybrid_score", "classify_cascade", "label_stats", "confusion_metrics",
    "stratified_split", "rebalance", "sft_rows", "pack_tokens", "undo_last", "apply_review_decisions",
    "review_progress", "parse_task_results", "label_with_model", "decide_actions", "html_to_text",
    "extract_links", "extract_answers", "compare_runs", "annotation_violations", "stream_ingest", "stream_score",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from winnowry.plans.catalog import QUERIES
    from winnowry.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
