"""Seconds of the headline queries as one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores.  The
four ``retrieve_*`` entries are the retrieval times of the method comparison
with a sample of 500 documents and five prompts each, indexes built before.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from larder.catalogue import inputs  # noqa: E402
from larder.catalogue.queries import QUERIES  # noqa: E402
from larder.plans.compare import compare  # noqa: E402
from larder.session import local_session, release  # noqa: E402

SAMPLE = 500
HEADLINE = (
    "fts_top10", "fts_turns_top10", "fts_postings", "knn_l2_top5", "knn_cosine_top5",
    "knn_approximate_top5",
    "embed_hashed", "hybrid_rrf_top5", "prompts_known_item", "prompts_negation",
    "ingest_search_text", "rewrite_negation", "rewrite_spelling", "rewrite_requests",
    "assess_score", "exclusion_hits", "recommend_status", "retrieve_recipes",
    "feedback_stats", "most_liked", "score_kde", "user_queries", "session_activity",
    "orphan_audit", "missing_images", "stream_feedback_daily", "stream_dedup",
)


def timed(name: str, run) -> float:
    """Seconds of ``run``, also told on standard error as soon as they are known."""
    started = time.perf_counter()
    run()
    took = round(time.perf_counter() - started, 3)
    print(f"{name}: {took}", file=sys.stderr, flush=True)
    return took


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, partitions=cores, app="larder-bench")
    documents = inputs.documents(spark, folder)
    size = min(SAMPLE, documents.count())
    compare(documents, min(50, size)).metrics().collect()  # start the workers

    seconds = {"index_documents": timed(
        "index_documents", lambda: inputs.document_index(spark, folder))}
    comparison = compare(documents, size)
    for method, took in comparison.seconds.items():
        seconds[f"retrieve_{method}"] = round(took, 3)
    quality = {row["method"]: {c: round(row[c], 4) for c in row.asDict() if c[-2:] in
                               ("_1", "_3", "_5")} for row in comparison.metrics().collect()}
    # what several queries share is timed by itself, so that none is timed on another's work
    seconds["recipe_index"] = timed(
        "recipe_index", lambda: inputs.recipe_index(spark, folder))
    seconds["answers"] = timed("answers", lambda: inputs.answers(spark, folder))
    for name in HEADLINE:
        seconds[name] = timed(name, lambda: QUERIES[name](spark, folder).write.format(
            "noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
        "retrieval_queries": comparison.truth.count(), "quality": quality}))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
