"""Benchmark: wall time of the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [--eventlog DIR] [names...]

Each query's plan is executed in full through the ``noop`` sink (nothing is
collected to the driver). Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "panel_weekly",
    "panel_daily",
    "feature_matrix",
    "feature_matrix_daily",
    "feature_matrix_lineitem",
    "panel_split",
    "tail_split",
    "metric_bundle",
    "metric_bundle_long",
    "leaderboard",
    "column_profile",
    "profile_violations",
    "psi_status",
    "rolling_wmape",
    "forecast_history",
    "request_volume",
    "prediction_histogram",
    "additive_forecast",
    "recursive_forecast",
    "panel_parts",
    "feature_matrix_parts",
    "metric_bundle_parts",
    "additive_forecast_parts",
    "feature_matrix_chunked",
    "recursive_forecast_parts",
    "batch_forecast",
    "univariate_baseline",
    "stream_hourly_requests",
    "stream_rolling_wmape",
    "model_comparison",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    args = sys.argv[1:]
    eventlog = None
    if args[:1] == ["--eventlog"]:
        eventlog, args = args[1], args[2:]
    names = args or HEADLINE

    from hindcast.plans.catalog import load_all
    from hindcast.session import local_session

    extra = {"spark.eventLog.enabled": "true", "spark.eventLog.dir": eventlog} if eventlog else None
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="hindcast-bench", extra_conf=extra)
    reg = load_all()
    # warm-up (JVM, code paths) -- not timed
    reg["panel_weekly"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    accuracy: dict[str, dict] = {}
    for n in names:
        spark.sparkContext.setJobGroup(n, n)
        t0 = time.perf_counter()
        df = reg[n].run(spark, sf_dir)
        if n == "model_comparison":
            # the leaderboard is one row per model: keep it as our accuracy
            # record on the P1 panel (not comparable with the reference's data)
            accuracy = {r["model"]: {k: v for k, v in r.asDict().items() if k != "model"} for r in df.collect()}
        else:
            df.write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "spark": spark.version,
    }
    if accuracy:
        out["accuracy_p1_panel"] = accuracy
    spark.stop()
    print(json.dumps(out))
    if eventlog:
        from tools.eventlog_report import read_events, summarise

        for g, v in sorted(summarise(read_events(eventlog)).items()):
            print(f"{g}: {v}", file=sys.stderr)


if __name__ == "__main__":
    main()
