"""Stage timings from a Spark event log (no UI needed).

usage: python tools/stage_times.py <event-log dir or file> [top_n]

Run a job with spark.eventLog.enabled=true and spark.eventLog.dir=<scratch
folder>; this prints the number of stages, the sum of their durations and the
longest stages with their task counts.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path: str):
    files = sorted(glob.glob(os.path.join(path, "**", "events_*"), recursive=True)) if os.path.isdir(path) else [path]
    for f in files:
        with open(f, "rb") as fh:
            if f.endswith(".zstd"):
                import zstandard
                stream = io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
            else:
                stream = io.TextIOWrapper(fh, encoding="utf-8")
            yield from stream


def main() -> None:
    path, top = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 10
    stages = {}
    for line in _lines(path):
        e = json.loads(line)
        if e.get("Event") == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            d = (si.get("Completion Time", 0) - si.get("Submission Time", 0)) / 1000
            stages[si["Stage ID"]] = (d, si["Number of Tasks"], si["Stage Name"][:60])
    print(f"stages {len(stages)}  sum of durations {sum(v[0] for v in stages.values()):.2f}s")
    for sid, (d, n, name) in sorted(stages.items(), key=lambda kv: -kv[1][0])[:top]:
        print(f"{sid:6d} {d:7.2f}s {n:5d} tasks  {name}")


if __name__ == "__main__":
    main()
