"""Per-stage row counts of a registered query, read from Spark's event log.

    python tools/stage_report.py [SF_DIR] [query ...]

Runs each query in a fresh local session whose event log goes to a new
scratch folder (``mktemp``), then summarizes every stage: tasks, input
rows, shuffle rows read and written, and the largest single task's rows.
Output goes to ``docs/stages/<query>.txt``. The point is to see that the
event volume is reduced by map-side aggregation before any shuffle and
that no task carries a disproportionate share.
"""

from __future__ import annotations

import glob
import json
import sys
import tempfile
from collections import defaultdict
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from pyspark.sql import SparkSession  # noqa: E402

from churnlab.plans.catalog import QUERIES  # noqa: E402

DEFAULT = ["jn4_user_matrix", "jn1_enriched_events"]


def summarize(log_file: str) -> list[dict]:
    stages: dict[int, dict] = defaultdict(lambda: defaultdict(int))
    names: dict[int, str] = {}
    path = Path(log_file)
    files = sorted(p for p in path.iterdir() if p.name.startswith("events")) if path.is_dir() else [path]
    for line in (ln for f in files for ln in open(f)):
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerStageCompleted":
            info = ev["Stage Info"]
            names[info["Stage ID"]] = info["Stage Name"].split(" at ")[0]
            if info.get("Submission Time") and info.get("Completion Time"):
                stages[info["Stage ID"]]["ms"] = info["Completion Time"] - info["Submission Time"]
        if kind != "SparkListenerTaskEnd" or "Task Metrics" not in ev:
            continue
        m = ev["Task Metrics"]
        s = stages[ev["Stage ID"]]
        rows_in = m.get("Input Metrics", {}).get("Records Read", 0)
        sh_read = m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0)
        sh_write = m.get("Shuffle Write Metrics", {}).get("Shuffle Records Written", 0)
        s["tasks"] += 1
        s["input_rows"] += rows_in
        s["shuffle_rows_read"] += sh_read
        s["shuffle_rows_written"] += sh_write
        s["max_task_rows"] = max(s["max_task_rows"], rows_in + sh_read)
    return [{"stage": k, "name": names.get(k, "?"), **dict(v)} for k, v in sorted(stages.items())]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or DEFAULT
    out = ROOT / "docs" / "stages"
    out.mkdir(parents=True, exist_ok=True)
    for name in names:
        log_dir = tempfile.mkdtemp(prefix="churnlab-eventlog-")
        spark = (
            SparkSession.builder.master("local[8]")
            .config("spark.ui.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.eventLog.enabled", "true")
            .config("spark.eventLog.dir", log_dir)
            .config("spark.eventLog.compress", "false")
            .getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spark.stop()
        log_file = sorted(glob.glob(f"{log_dir}/*"))[0]
        lines = [f"-- {name} on {sf_dir}: per-stage rows from the event log (local[8])",
                 f"{'stage':>5} {'tasks':>5} {'ms':>6} {'input':>9} {'sh_read':>9} {'sh_write':>9} {'max_task':>9}"]
        for s in summarize(log_file):
            lines.append(
                f"{s['stage']:>5} {s.get('tasks', 0):>5} {s.get('ms', 0):>6} {s.get('input_rows', 0):>9} "
                f"{s.get('shuffle_rows_read', 0):>9} {s.get('shuffle_rows_written', 0):>9} {s.get('max_task_rows', 0):>9}"
            )
        (out / f"{name}.txt").write_text("\n".join(lines) + "\n")
        print("\n".join(lines))


if __name__ == "__main__":
    main()
