"""Time the registered queries; prints one JSON line.

BENCH_SF_DIR   folder of the test tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated keys, or "all" (default: the headline queries)
BENCH_RUNS     timed runs per query, of which the best counts (default 2)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sellerlens.catalog import registry  # noqa: E402
from sellerlens.session import local_session  # noqa: E402

HEADLINE = [
    "orders_by_article_today", "orders_by_article_this_week", "orders_by_article_prev_month",
    "orders_by_article_last30", "orders_with_stock", "orders_top50", "orders_totals",
    "sales_by_article_last30", "sales_by_article_prev_month", "stock_by_article", "stock_low50",
    "series_last7", "series_last365", "series_all", "scan_sales", "distinct_orders",
    "orders_per_product", "campaign_list_flatten", "campaign_flatten", "ad_stats_flatten",
    "ad_stats_dedup", "ad_stats_with_position", "campaign_metrics", "ad_by_product",
    "ad_drr_by_article", "spend_orders_outer", "drr_top20", "spend_reconcile", "keyword_daily",
    "keyword_top", "cluster_keywords", "remains_flatten", "remains_grouped", "remains_cube",
    "settlement_labels", "settlement_labelled", "settlement_report_index", "settlement_net_tax",
    "slot_search", "slot_alerts_stream", "backfill_windows", "rows_per_window", "missing_slices",
]


def seconds(run, spark, folder) -> float:
    began = time.perf_counter()
    run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    entries = registry().entries
    chosen = os.environ.get("BENCH_QUERIES", "")
    keys = list(entries) if chosen == "all" else [k for k in chosen.split(",") if k] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory="16g", app="sellerlens-bench")
    seconds(entries["stock_by_article"].run, spark, folder)  # start the engine outside the timings
    timings = {}
    for key in keys:
        timings[key] = round(min(seconds(entries[key].run, spark, folder) for _ in range(runs)), 4)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
