"""Time the headline queries on one scale factor; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lectern.plans import catalog  # noqa: E402
from lectern.session import local_session  # noqa: E402

HEADLINE = (
    "tokenize", "clean_text", "chunk_windows", "chunk_duplicates", "corpus_stats", "bm25_topk", "dense_topk",
    "hybrid_retrieve", "lexical_rerank", "grounded_context", "retrieval_quality", "exact_lookup", "vector_neighbours",
    "topic_evidence", "evidence_merge", "paper_parse", "memory_state", "telemetry_summary", "grade_review",
    "grade_agreement", "marking_contract", "citation_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS"), "lectern-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall clock", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
