"""Per-stage wall time and task counts from a Spark event log (no UI).

usage: python tools/stage_times.py <event-log file or rolling-log folder> [top_n]
"""

from __future__ import annotations

import json
import os
import sys


def _lines(path):
    files = [path] if os.path.isfile(path) else sorted(
        os.path.join(path, f) for f in os.listdir(path) if f.startswith("events_"))
    for fp in files:
        if fp.endswith(".zstd"):
            import io

            import zstandard

            with open(fp, "rb") as raw:
                reader = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
                yield from io.TextIOWrapper(reader, encoding="utf-8")
        else:
            with open(fp, encoding="utf-8") as f:
                yield from f


def main():
    path = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 25
    stages = []
    for line in _lines(path):
        ev = json.loads(line)
        if ev.get("Event") != "SparkListenerStageCompleted":
            continue
        info = ev["Stage Info"]
        start, end = info.get("Submission Time"), info.get("Completion Time")
        if start is None or end is None:
            continue
        stages.append((end - start, info["Stage ID"], info.get("Number of Tasks"), info.get("Stage Name", "")[:80]))
    stages.sort(reverse=True)
    print(f"{'ms':>8} {'stage':>6} {'tasks':>6}  name")
    for ms, sid, tasks, name in stages[:top]:
        print(f"{ms:>8} {sid:>6} {tasks:>6}  {name}")
    print(f"# {len(stages)} stages, {sum(s[0] for s in stages)} ms in total")


if __name__ == "__main__":
    main()
