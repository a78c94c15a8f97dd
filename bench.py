"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from tickloom.catalog import load
from tickloom.session import local_session

HEADLINE = (
    "feature_frame",
    "trend_slope",
    "ema",
    "cci",
    "high_volatility",
    "label_signals",
    "signal_mix",
    "barrier_outcomes",
    "grid_rank",
    "bars_normalized",
    "quality_report",
    "gap_report",
    "describe_features",
    "corr_pairs",
    "trade_summary",
    "performance_summary",
    "equity_curve",
    "run_insights",
    "error_health",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), memory="12g")
    registry = load()
    registry["signal_mix"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
