"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from carecheck.plans import pipeline, reports  # noqa: E402
from carecheck.session import build_session  # noqa: E402
from carecheck.sources.facilities import order_facilities  # noqa: E402
from checks.queries import BUILDERS, Run  # noqa: E402

HEADLINES = [
    "rule_counts", "gold_facilities", "claims_long", "audit_kpis", "desert_oncology", "per_million",
    "radius_search", "provider_rank", "bm25_topk", "vector_topk", "hybrid_topk", "cross_source",
    "verify_answers", "field_extract", "index_incremental", "rules_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "carecheck-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
           "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def rules_on_orders():
        """The rules over one facility per order: the largest listing the tables give."""
        run = pipeline.build(spark, order_facilities(spark, folder))
        return reports.rule_counts(run.contradictions)

    seconds = {}

    def timed(name, action):
        start = time.perf_counter()
        result = action()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    def save(df):
        df.write.format("noop").mode("overwrite").save()

    raw = Run(spark, folder)
    save(BUILDERS["state_counts"](raw))  # start-up is not measured
    # tables are written once, as the pipeline does; the queries read them
    stored = timed("store_tables", lambda: pipeline.store(raw.tables, raw.scratch()))
    timed("rules_on_orders", lambda: save(rules_on_orders()))
    timed("rule_counts_from_raw", lambda: save(BUILDERS["rule_counts"](Run(spark, folder))))
    for name in sys.argv[1:] or HEADLINES:
        timed(name, lambda: save(BUILDERS[name](Run(spark, folder, stored))))
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(os.path.basename(folder.rstrip("/")).removeprefix("sf") or 0),
    }))


if __name__ == "__main__":
    main()
