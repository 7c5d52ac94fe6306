"""Per-query stages and shuffle volume from Spark's event log (no UI).

usage: python tools/stage_report.py [sf_dir] [key ...]
Runs each query into the ``noop`` sink under its own job group with the event log written to a
fresh scratch folder, then sums, per query, jobs, stages, tasks, rows read from files, rows and
bytes written to shuffle. ``shuffled / read`` is how many times an input row crosses the
network on average: the figure that decides cost at scale. Prints a markdown table.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from runlens.plans import registry  # noqa: E402
from runlens.plans.session import build_session  # noqa: E402


def _acc(info: dict, name: str) -> int:
    for a in info.get("Accumulables", []):
        if a.get("Name") == name:
            try:
                return int(a.get("Value", 0))
            except (TypeError, ValueError):
                return 0
    return 0


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    keys = sys.argv[2:] or [k for k in HEADLINE if not k.startswith("stream_") and k != "predict_failure"]
    logdir = tempfile.mkdtemp(prefix="run-eventlog-")
    spark = build_session(app="runlens-stages", extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": logdir,
                                                            "spark.eventLog.compress": "false",
                                                            "spark.eventLog.rolling.enabled": "false"})
    registry.load_all()
    sc = spark.sparkContext
    for k in keys:
        sc.setJobGroup(k, k)
        registry.QUERIES[k](spark, sf).write.format("noop").mode("overwrite").save()
    sc.setJobGroup("done", "done")
    spark.stop()
    job_group, stage_job = {}, {}
    stats: dict[str, dict] = {}
    for path in [p for p in glob.glob(f"{logdir}/**/*", recursive=True) if os.path.isfile(p)]:
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    g = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    job_group[ev["Job ID"]] = g
                    for sid in ev.get("Stage IDs", []):
                        stage_job[sid] = ev["Job ID"]
                elif kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    g = job_group.get(stage_job.get(info["Stage ID"]))
                    if g not in keys:
                        continue
                    s = stats.setdefault(g, {"stages": 0, "tasks": 0, "input": 0, "shuffle_rows": 0, "shuffle_write": 0,
                                             "jobs": set()})
                    s["stages"] += 1
                    s["tasks"] += info.get("Number of Tasks", 0)
                    s["input"] += _acc(info, "internal.metrics.input.recordsRead")
                    s["shuffle_rows"] += _acc(info, "internal.metrics.shuffle.write.recordsWritten")
                    s["shuffle_write"] += _acc(info, "internal.metrics.shuffle.write.bytesWritten")
                    s["jobs"].add(stage_job.get(info["Stage ID"]))
    print(f"| query ({os.path.basename(sf)}) | jobs | stages | tasks | rows read | rows shuffled | shuffle bytes | shuffled / read |")
    print("|---|---|---|---|---|---|---|---|")
    for k in keys:
        s = stats.get(k)
        if not s:
            continue
        ratio = s["shuffle_rows"] / s["input"] if s["input"] else 0.0
        print(f"| {k} | {len(s['jobs'])} | {s['stages']} | {s['tasks']} | {s['input']:,} | {s['shuffle_rows']:,} "
              f"| {s['shuffle_write']:,} | {ratio:.2f} |")


if __name__ == "__main__":
    main()
