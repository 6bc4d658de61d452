"""Headline queries, timed; prints one JSON line.

Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_QUERIES (names, comma separated).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from treegauge.session import build_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "catalogue_kinds", "innermost_rule", "gitignore_filter", "union_scope",
    "journal_states", "journal_moved", "backfill_cold", "content_classify",
    "edges_build", "neighbours_2hop", "symbols_of", "lexical_search", "lexical_index",
    "phrase_search", "lexical_many", "chunks", "vector_maintenance", "semantic_search",
    "semantic_many", "fused_search", "rrf_ties", "retrieval_eval", "freshness_per_file",
    "stale_dirs", "tree_fingerprint", "identity_verdict", "snapshot_retention",
    "tree_nodes", "store_equivalence", "event_attribution", "debounce_sessions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("local[%s]" % cpus, **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"})
    # The session starts its Python workers and code paths once, untimed.
    spark.read.parquet(folder + "/nation.parquet").groupBy("n_regionkey").count().collect()
    timed = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timed[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(timed.values()), 3),
        "unit": "sec", "queries": timed, "sf": os.path.basename(folder.rstrip("/")).replace("sf", ""),
        "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
