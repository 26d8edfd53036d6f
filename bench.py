"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import time

from panelark.plans.catalog import QUERIES
from panelark.session import local_session

HEADLINE = [
    "returns",
    "moving_averages",
    "rsi",
    "macd",
    "volume_flows",
    "cross_asset",
    "sentiment_windows",
    "lexicon_sentiment",
    "daily_rank_ic",
    "ic_statistics",
    "newey_west",
    "stability",
    "correlation_matrix",
    "quality_gate",
    "drift_report",
    "embargoed_folds",
    "trade_costs",
    "period_returns",
    "strategy_performance",
    "cash_weights",
    "order_fills",
    "signal_log_chain",
    "lead_screen",
    "price_levels",
    "full_feature_matrix",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "16g"), "panelark-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    times: dict[str, float] = {}
    for name in chosen:
        start = time.perf_counter()
        # every row is computed, none is sent to the driver
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
