"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scholion.plans import collect  # noqa: E402
from scholion.session import build_session, release_scratch  # noqa: E402

HEADLINE = [
    "q2_vector_topk", "q2_vector_knn_all", "q8_keyword_topk", "q9_hybrid_rrf", "q10_enriched_hits",
    "r1_context", "r7_rag_requests", "q5_postings", "q14_title_similarity", "c3_pack_paragraphs",
    "c5_fixed_size_chunks", "c9_linked_chunks", "c10_dedup_chunks", "e1_embed_batches", "p16_full_text",
    "p21_sections_from_text", "g2_chunk_stats", "g10_recent_searches", "g12_bookmarks", "j2_job_state",
    "j8_rate_limit", "j10_paired_requests",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "20g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = collect()[0]
    # One untimed run on a small query loads classes and starts the Python workers.
    queries["q9_hybrid_rrf"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        release_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
