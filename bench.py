"""Time the headline queries: one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seriesloom.plans import QUERIES  # noqa: E402
from seriesloom.session import local_session  # noqa: E402

HEADLINE = [
    "g09_pair_metrics", "g09_user_pair_metrics", "x02_hourly_users", "c03_ordered_shipments", "c07_fill_shipments",
    "f05_user_lags", "f05_shipment_lags", "f13_scaled", "w01_shipment_windows", "w07_trailing_mean", "e03_merge_strict_mean",
    "g11_ljung_box", "m01_ridge_on_shipments", "m02_plain_forecast", "m04_rolling_refit", "m04_rolling_refit_shipments",
    "m05_trend_forecast", "m08_forest", "m10_change_forecast", "m11_horizon_forecast", "x01_stream_forecast",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    QUERIES["e16_extent"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up and compiled code, not measured
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder)}))


if __name__ == "__main__":
    main()
