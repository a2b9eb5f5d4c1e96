"""Time staging and the headline reports; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import CASES, Tables
from lanewise import local_session

HEADLINES = (
    "o01_carrier_transit",
    "o03_client_otp_otd_summary",
    "o06_client_detail",
    "o08_otp_otd_trend_month",
    "o11_profit_by_lane_all",
    "o11_profit_by_lane_all_reference",
    "o13_drill_down_customer_all",
    "o15_within_market_all",
    "o19_ltl_market_quarter_corrected",
    "o22_market_trends",
    "o26_carrier_otp",
    "o30_site_otd",
    "o31_lane_profit_orders",
    "r02_classify_order",
    "r05_ltl_order_revenue",
    "a16_metric_stats",
    "k07_cross_validate",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench", spark__sql__shuffle__partitions=cores)
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor before the clock

    tables = Tables(spark, sf_dir)
    seconds = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    timed("stage_legs", lambda: tables.legs)
    for name in HEADLINES:
        timed(name, lambda n=name: CASES[n].build(tables).write.format("noop").mode("overwrite").save())

    result = {
        "metric": "staging and headline reports",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
