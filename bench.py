"""Time the headline queries and print one JSON line."""

import json
import os
import sys
import tempfile
import time

from plumbline import build_session
from plumbline.plans import registry

HEADLINE = [
    "q3_bm25", "q5_cosine", "q8_rrf", "g2_locate_exact", "g4_locate_approx", "c11_proper_nouns", "a2_word_recall", "a7_timeline",
    "e2_faithfulness", "e10_cost", "k9_edges", "k12_similar_pairs", "l5_title_match", "r1_job_state", "t2_subtree_totals", "p17_sentences",
    "k4_families", "a17_detection_rate", "c14_detection_rate", "g5_resolve", "s11_backfill", "l6_suggest", "k6_canonical_names",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shared = tempfile.mkdtemp(prefix="spark-")
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, shared)
    queries = registry.queries()
    spark.range(1).count()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
