"""The end-to-end batch job on a JSON log derived from the driver's events."""


from churnlab.operators.matrix import user_matrix
from churnlab.plans.catalog import events as adapted_events
from churnlab.plans.job import run
from conftest import SF01


def test_job_end_to_end(spark, tmp_path):
    ev = adapted_events(spark, SF01)
    log = str(tmp_path / "log")
    ev.withColumnRenamed("seq", "itemInSession").write.json(log)
    out = run(spark, log, str(tmp_path / "out"), fmt="json", grid="notebook")
    assert 0.0 <= out["accuracy"] <= 1.0 and 0.0 <= out["f1"] <= 1.0
    saved = spark.read.schema(user_matrix(ev).schema).json(out["matrix_path"])
    assert sorted(saved.collect()) == sorted(user_matrix(ev).collect())
    metrics = spark.read.json(out["model_path"] + "/metrics").first()
    assert abs(metrics.f1 - out["f1"]) < 1e-12


def test_job_command_line_picks_the_small_log(spark, tmp_path):
    import json
    import subprocess
    import sys

    from conftest import ROOT

    ev = adapted_events(spark, SF01)
    small = str(tmp_path / "small")
    ev.withColumnRenamed("seq", "itemInSession").write.json(small)
    out = str(tmp_path / "out")
    cmd = [sys.executable, "-m", "churnlab.plans.job", "mini", "--mini", small, "--full", str(tmp_path / "missing"),
           "--out", out, "--grid", "notebook"]
    done = subprocess.run(cmd, cwd=ROOT, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-2000:]
    result = json.loads(done.stdout.strip().splitlines()[-1])
    assert result["model_path"].startswith(out) and 0.0 <= result["f1"] <= 1.0
