"""Slowest stages from a Spark event log folder (no web UI needed).

    d=$(mktemp -d /tmp/run-XXXXXX); BENCH_EVENTLOG_DIR=$d python bench.py gold_panel
    python tools/stage_times.py $d [top]
"""

from __future__ import annotations

import io
import json
import os
import sys

import zstandard


def _lines(path: str):
    with open(path, "rb") as fh:
        if path.endswith(".zstd"):
            reader = zstandard.ZstdDecompressor().stream_reader(fh, read_across_frames=True)
            yield from io.TextIOWrapper(reader, errors="ignore")
        else:
            yield from io.TextIOWrapper(fh, errors="ignore")


def stages(folder: str):
    out = []
    for root, _, files in os.walk(folder):
        for fn in files:
            if fn.startswith(".") or fn.startswith("appstatus"):
                continue
            for line in _lines(os.path.join(root, fn)):
                try:
                    ev = json.loads(line)
                except ValueError:
                    continue
                if isinstance(ev, dict) and ev.get("Event") == "SparkListenerStageCompleted":
                    si = ev["Stage Info"]
                    out.append((si.get("Completion Time", 0) - si.get("Submission Time", 0),
                                si["Stage ID"], si["Number of Tasks"], si["Stage Name"]))
    return sorted(out, reverse=True)


def main():
    folder = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    st = stages(folder)
    print(f"{len(st)} stages, {sum(s[0] for s in st)} ms in total")
    for ms, sid, ntasks, name in st[:top]:
        print(f"{ms:7d} ms  stage {sid:4d}  tasks {ntasks:5d}  {name[:70]}")


if __name__ == "__main__":
    main()
