"""Summarise the physical plan of every registered query.

    python tools/plan_report.py [--sf /root/testdata/sf0.01] > PLANS.md

For each query: parquet scans with their ReadSchema and PushedFilters, and
the number of Exchanges, Windows, broadcasts, sort-merge joins, Python
(Arrow) evaluations and subqueries in the (initial, adaptive) physical plan.
"""

from __future__ import annotations

import argparse
import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


#: building their plan runs a fit or a stream
RUNS = {
    "quantile_forecast", "recursive_forecast", "recursive_forecast_parts", "model_comparison", "model_artifact", "model_artifact_check", "quantile_fit_check",
    "recursive_forecast_check", "recursive_forecast_parts_check", "model_comparison_check", "stream_hourly_requests", "stream_rolling_wmape", "stream_retrain_trigger",
}


def summarise(text: str) -> dict:
    nodes = re.findall(r"^\(\d+\) ([A-Za-z]+(?: [A-Za-z]+)?)", text, flags=re.M)

    def count(prefix: str) -> int:
        return sum(1 for n in nodes if n.startswith(prefix))

    scans = []
    for block in (b.strip() for b in re.split(r"\n\n", text)):
        if block.startswith("(") and "Scan parquet" in block.splitlines()[0]:
            schema = re.search(r"ReadSchema: struct<(.*)>", block)
            pushed = re.search(r"PushedFilters: \[(.*)\]", block)
            loc = re.search(r"Location: \w+ \[(.*?)\]", block)
            scans.append(
                (
                    os.path.basename(loc.group(1)) if loc else "?",
                    ", ".join(f.split(":")[0] for f in schema.group(1).split(",")) if schema else "",
                    pushed.group(1) if pushed else "",
                )
            )
    return {
        "exchange": count("Exchange"),
        "broadcast": count("BroadcastExchange"),
        "window": count("Window"),
        "smj": count("SortMergeJoin"),
        "python": count("ArrowEvalPython") + count("FlatMapGroupsIn") + count("MapInArrow"),
        "subquery": len(re.findall(r"^Subquery:\d+", text, flags=re.M)),
        "scans": scans,
    }


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import io
    from contextlib import redirect_stdout

    from hindcast.plans.catalog import load_all
    from hindcast.session import local_session

    spark = local_session(8)
    reg = load_all()
    names = args.names or [n for n in reg if n not in RUNS]
    print("| query | scans: table (columns read) [pushed filters] | exchanges | broadcast | windows | SMJ | python | subqueries |")
    print("|---|---|---:|---:|---:|---:|---:|---:|")
    for n in names:
        if reg[n].tags and "side_effect" in reg[n].tags:
            continue
        try:
            df = reg[n].run(spark, args.sf)
            buf = io.StringIO()
            with redirect_stdout(buf):
                df.explain("formatted")
            s = summarise(buf.getvalue())
        except Exception as e:  # noqa: BLE001
            print(f"| {n} | error: {str(e)[:80]} | | | | | | |")
            continue
        scans = "<br>".join(f"{t} ({c}) [{p}]" for t, c, p in s["scans"])
        print(f"| {n} | {scans} | {s['exchange']} | {s['broadcast']} | {s['window']} | {s['smj']} | {s['python']} | {s['subquery']} |")
    spark.stop()


if __name__ == "__main__":
    main()
