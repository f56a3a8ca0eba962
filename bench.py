"""Headline queries, timed end to end; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

from tsudoi.plans import catalog
from tsudoi.session import local_session

HEADLINE = ("span_merge", "schedule_status", "schedule_today", "explore_listing", "exact_match", "match_decisions", "quota_selection",
            "theme_evidence", "field_diffs", "field_review_sync", "place_rules", "opening_hours", "page_metadata", "detail_records", "dedupe_decisions")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    catalog.QUERIES["count_by_status"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up is not a query
    took = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 2)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_query_seconds", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": os.path.basename(folder).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
