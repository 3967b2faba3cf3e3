"""Benchmark: run the headline queries and print one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_WARMUP_DIR (default /root/testdata/sf0.001; empty string disables).

Each query is executed in full through the ``noop`` sink (every stage runs,
nothing is collected). Before timing, every headline query runs once on the
small warm-up scale so that one-off JVM and code-generation compile time
(independent of data size) is not counted; the JSON also reports the total
of that warm-up pass as ``warmup_sec``, and for each query, within its time,
what building its DataFrame took (fits and their jobs included) as
``build_sec``.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from panelcraft.plans import catalog  # noqa: E402
from panelcraft.session import build_session  # noqa: E402
from panelcraft.session import release_materialised  # noqa: E402

HEADLINE = [
    "quarterly_panel",
    "monthly_panel",
    "interval_monthly_sum",
    "guest_features",
    "host_features",
    "key_intersection",
    "bills_monthly",
    "first_line_per_order",
    "describe_price",
    "zscore",
    "quantile_bins_exact",
    "quantile_bins_approx",
    "outlier_filter",
    "regression_metrics",
    "error_report",
    "kfold_ids",
    "gbt_predict",
    "gbt_lineitem",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        f"local[{cpus}]",
        app_name="panelcraft-bench",
        shuffle_partitions=max(8, 2 * cpus),
        conf={"spark.driver.memory": "16g", "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024)},
    )
    qs = catalog.queries()
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    t_warm = time.perf_counter()
    if warm_dir and Path(warm_dir).exists():
        for name in HEADLINE:
            qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    else:
        qs["value_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    warmup = round(time.perf_counter() - t_warm, 3)
    times: dict[str, float] = {}
    built: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        df = qs[name](spark, sf_dir)
        built[name] = round(time.perf_counter() - t0, 3)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = Path(sf_dir).name.replace("sf", "")
    out = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "warmup_sec": warmup,
        "build_sec": built,
    }
    print(json.dumps(out))
    release_materialised(spark)  # every result has been consumed
    spark.stop()


if __name__ == "__main__":
    main()
