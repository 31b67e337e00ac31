"""Headline queries, timed; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores,
``BENCH_QUERIES`` (optional, comma separated) replaces the headline list.
"""
from __future__ import annotations

import json
import os
import time

from gleaner.plans import catalog
from gleaner.session import local_session

HEADLINE = [
    "clean_documents", "word_chunks", "source_chunk_totals", "paragraph_chunks", "section_chunks",
    "article_chunks", "xml_texts", "quality_scores", "content_checks", "completeness_checks",
    "exact_copy_groups", "similar_question_pairs", "deduplicated_questions",
    "vector_duplicate_edges", "deduplicated_vectors", "validated_pairs", "curated_pairs",
    "diverse_top_chunks", "topic_evidence", "embedded_chunks", "evidence_prompts",
    "sampled_prompts", "generated_pairs", "parsed_responses", "coerced_reviews",
    "approval_workflow", "pair_stats", "pairs_by_file", "project_rollup", "latest_progress",
    "dataset_split", "csv_export", "chat_export", "projects_deleted",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    if chosen == "all":
        names = list(catalog.QUERIES)
    spark.read.parquet(f"{sf_dir}/documents.parquet").count()  # start the JVM and the workers
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
