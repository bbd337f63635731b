"""Headline-query benchmark.

Runs the headline queries at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]`` and prints one JSON line.  Each query is forced
with the ``noop`` sink, so the whole plan runs without collecting rows.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "functions", "function_bodies", "file_metrics", "repo_summary", "summary_report", "important_files",
    "internal_deps", "top_imports", "directory_tree", "line_metrics", "vocabulary", "search", "answers",
    "kb_docs", "file_docs", "kb_search",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from sourcelens.plans import catalog
    from sourcelens.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="sourcelens-bench")
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in catalog.QUERIES]
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    # what the reports share is prepared on its own, so no query's time holds another's preparation
    for name, build in (("prepare_analysis", catalog.analyzed), ("prepare_index", catalog.doc_index),
                        ("prepare_knowledge_base", catalog.knowledge_base), ("prepare_kb_index", catalog.kb_index)):
        t0 = time.perf_counter()
        build(spark, sf_dir)
        times[name] = round(time.perf_counter() - t0, 3)
    for name in names:
        t0 = time.perf_counter()
        try:
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 — report and keep measuring the rest
            failed[name] = str(e).splitlines()[0][:200]
            print(f"{name} failed: {failed[name]}", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
