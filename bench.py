"""Wall seconds per headline query; prints one JSON line.

BENCH_SF_DIR   input tables        (default /root/testdata/sf0.1)
BENCH_CPUS     local cores         (default 8)
BENCH_QUERIES  comma list or "all" (default: the headline set)
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tutelage.plans.registry import QUERIES  # noqa: E402
from tutelage.session import local_session  # noqa: E402

HEADLINE = [
    "attempt_log", "item_state", "attempt_history", "emit_points", "study_report", "gaps",
    "next_due", "next_question", "next_action", "unseen_questions", "coverage",
    "mastery_digest", "stable_ids", "extract_bank", "migrate_ids", "chunk_paragraphs",
    "chunk_lessons", "speech_chunks", "flashcards", "lesson_documents", "course_findings",
    "corpus_budget", "content_dedupe", "eval_summary", "eval_formulas", "generate_problems",
    "stream_item_state",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = local_session(cores, memory="16g")
    # one small job, so the first query does not pay for starting the engine
    spark.read.parquet(f"{sf}/region.parquet").groupBy("r_name").count().collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf)
    print(json.dumps({
        "metric": "total wall time of the query set", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": float(scale.group(1)) if scale else None,
        "cores": cores, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
