"""Stage count, task count and shuffle bytes per query, from Spark's event log.

    python tools/stage_stats.py [--sf DIR] name [name ...]

The event log goes to a fresh scratch folder; the UI stays off.
"""

from __future__ import annotations

import argparse
import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.plans.registry import load_all  # noqa: E402
from quarry.session import local_session  # noqa: E402


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("names", nargs="+")
    args = ap.parse_args()
    logdir = tempfile.mkdtemp(prefix="quarry-events-")
    spark = local_session(8, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": logdir,
                                    "spark.eventLog.compress": "false"})
    reg = load_all()
    marks = []
    for name in args.names:
        spark.sparkContext.setJobGroup(name, name)
        reg[name].build(spark, args.sf).write.format("noop").mode("overwrite").save()
        marks.append(name)
    spark.stop()
    stats = {n: {"jobs": 0, "stages": 0, "tasks": 0, "shuffle_write_bytes": 0, "shuffle_read_bytes": 0}
             for n in marks}
    stage_group = {}
    paths = [p for p in glob.glob(os.path.join(logdir, "**", "*"), recursive=True) if os.path.isfile(p)]
    for path in sorted(paths):
        if os.path.basename(path).startswith("appstatus"):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    if group in stats:
                        stats[group]["jobs"] += 1
                        for sid in ev.get("Stage IDs", []):
                            stage_group[sid] = group
                elif kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    group = stage_group.get(info["Stage ID"])
                    if group is None:
                        continue
                    s = stats[group]
                    s["stages"] += 1
                    s["tasks"] += info.get("Number of Tasks", 0)
                    for acc in info.get("Accumulables", []):
                        if acc.get("Name") == "internal.metrics.shuffle.write.bytesWritten":
                            s["shuffle_write_bytes"] += int(acc.get("Value", 0))
                        elif acc.get("Name") == "internal.metrics.shuffle.read.remoteBytesRead":
                            s["shuffle_read_bytes"] += int(acc.get("Value", 0))
                        elif acc.get("Name") == "internal.metrics.shuffle.read.localBytesRead":
                            s["shuffle_read_bytes"] += int(acc.get("Value", 0))
    print(json.dumps(stats, indent=1))


if __name__ == "__main__":
    main()
