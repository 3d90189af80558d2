"""Summarise a Spark event log by job group: jobs, stages, tasks, time.

    python tools/eventlog_report.py /path/to/eventlog_dir

``bench.py --eventlog DIR`` writes such a log with one job group per query.
"""

from __future__ import annotations

import collections
import glob
import io
import json
import os
import sys


def read_events(path: str) -> list[dict]:
    files = sorted(glob.glob(os.path.join(path, "**", "events_*"), recursive=True)) or sorted(
        glob.glob(os.path.join(path, "*"))
    )
    events = []
    for f in files:
        if os.path.isdir(f):
            continue
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            import zstandard

            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode("utf-8", "replace").splitlines():
            try:
                events.append(json.loads(line))
            except json.JSONDecodeError:
                pass
    return events


def summarise(events: list[dict]) -> dict[str, dict]:
    jobs, stage_job = {}, {}
    for e in events:
        ev = e.get("Event")
        if ev == "SparkListenerJobStart":
            group = (e.get("Properties") or {}).get("spark.jobGroup.id", "-")
            jobs[e["Job ID"]] = {"start": e["Submission Time"], "end": None, "group": group}
            for s in e.get("Stage IDs", []):
                stage_job[s] = e["Job ID"]
        elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
            jobs[e["Job ID"]]["end"] = e["Completion Time"]
    out: dict[str, dict] = collections.defaultdict(lambda: {"jobs": 0, "job_sec": 0.0, "stages": set(), "tasks": 0, "task_sec": 0.0})
    for j in jobs.values():
        if j["end"] is not None:
            g = out[j["group"]]
            g["jobs"] += 1
            g["job_sec"] += (j["end"] - j["start"]) / 1000
    for e in events:
        if e.get("Event") == "SparkListenerTaskEnd" and e["Stage ID"] in stage_job:
            g = out[jobs[stage_job[e["Stage ID"]]]["group"]]
            g["stages"].add(e["Stage ID"])
            g["tasks"] += 1
            info = e["Task Info"]
            g["task_sec"] += (info["Finish Time"] - info["Launch Time"]) / 1000
    return {k: {**v, "stages": len(v["stages"])} for k, v in out.items()}


def main() -> None:
    res = summarise(read_events(sys.argv[1]))
    print("| job group | jobs | stages | tasks | job time (s, summed) | task time (s) |")
    print("|---|---:|---:|---:|---:|---:|")
    for g, v in sorted(res.items()):
        print(f"| {g} | {v['jobs']} | {v['stages']} | {v['tasks']} | {v['job_sec']:.1f} | {v['task_sec']:.1f} |")


if __name__ == "__main__":
    main()
