"""Benchmark: one JSON line with seconds per headline query.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES
(comma-separated names, optional).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "judge_comparison",
    "classification_report",
    "latency_linear",
    "status_counts",
    "resource_usage",
    "judge_agreement",
    "paired_significance",
    "shared_competition_ranks",
    "risk_coverage_curve",
    "target_coverage",
    "threshold_selection",
    "temperature_fit",
    "temperature_applied",
    "policy_report",
    "first_ok_merge",
    "key_uniqueness_rule",
    "split_isolation_rule",
    "weighted_split",
    "exact_count_split",
    "stable_sample_per_source",
    "table_fingerprint",
    "pairwise_question_records",
    "registry_fact_claims",
    "numeric_answer_pairs",
    "free_text_verdicts",
    "typed_responses",
    "choice_outputs",
    "edge_holdout",
    "graph_search",
    "retrieval_study",
    "bm25_search",
    "vector_search",
    "ledger_findings",
    "tidy_observations",
)


def main() -> None:
    from assay.plans import load_entries
    from assay.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = build_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("OFF")
    entries = load_entries()
    # start the JVM paths that every query shares
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    seconds: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
