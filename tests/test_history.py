"""Pages of a run's children (J3), first actions of the newest runs (J1) and one-row lookups."""

from pyspark.sql import functions as F

from runlens.operators import ci as CI
from runlens.operators import runs as R


def _tables(spark):
    times = "started_at timestamp_ntz, completed_at timestamp_ntz, created_at timestamp_ntz"
    at = lambda df, *cols: df.select(*[F.col(c) if c in df.columns else F.lit("2024-01-01").cast("timestamp_ntz").alias(c) for c in cols])
    runs = spark.createDataFrame([(1, "1", "r", "completed", "failure"), (2, "2", "r", "completed", "success"), (3, "3", "r", "queued", None)],
                                 "id long, run_id string, repo string, status string, conclusion string")
    runs = at(runs, *R.RUN_COLUMNS)
    logs = spark.createDataFrame([(100 + i, "1", f"t{i}", "m", "", "medium") for i in range(7)] + [(200, "gone", "t", "m", "", "medium")],
                                 "id long, run_id string, error_type string, error_message string, stack_trace string, severity string")
    logs = at(logs, *R.SERIALIZED["failure_logs"])
    actions = spark.createDataFrame([(50, "1", "a", False, "{}"), (40, "1", "b", True, "{}"), (60, "2", "c", True, None)],
                                    "id long, run_id string, action_type string, success boolean, details string")
    actions = at(actions.withColumn("changes_made", F.array(F.lit("x"))), *R.SERIALIZED["healing_actions"])
    return runs, logs, actions, times


def test_pages_hold_every_child_once(spark):
    runs, logs, actions, _ = _tables(spark)
    got = {(r.run_id, r.page): r for r in R.history_pages(runs, logs, actions, page=3).collect()}
    assert set(got) == {("1", 0), ("1", 1), ("1", 2), ("2", 0), ("3", 0)}
    assert [[f.id for f in got["1", p].failures] for p in range(3)] == [[100, 101, 102], [103, 104, 105], [106]]
    assert [[(a.id, a.action_type, a.success, a.changes_made) for a in got["1", p].healing_actions] for p in range(3)] == [
        [(40, "b", True, ["x"]), (50, "a", False, ["x"])], [], []]
    assert got["3", 0].failures == [] and got["3", 0].healing_actions == [] and got["3", 0].status == "queued"
    f = got["1", 0].failures[0]
    assert (f.error_type, f.severity, str(f.created_at)) == ("t0", "medium", "2024-01-01 00:00:00")
    one = R.history_pages(runs, logs, actions, run_id="2").collect()
    assert [(r.run_id, len(r.failures), len(r.healing_actions)) for r in one] == [("2", 0, 1)]
    assert R.history_pages(runs, logs, actions, run_id="gone").collect() == []


def test_first_action_of_the_newest_runs(spark):
    runs, _, actions, _ = _tables(spark)
    got = {r.run_id: (r.healing_attempted, r.healing_successful) for r in R.recent_runs(runs, actions, limit=3).collect()}
    assert got == {"1": (True, True), "2": (True, True), "3": (False, False)}   # of run 1 the action with the least id counts
    assert [r.run_id for r in R.recent_runs(runs, actions, limit=1).collect()] == ["3"]


def test_lookups(spark):
    runs, logs, actions, _ = _tables(spark)
    assert R.get_run(runs, 2).first().conclusion == "success"
    assert R.get_row(logs, "id", 103).first().error_type == "t3" and R.get_row(actions, "id", 7).collect() == []


def test_logs_list_jobs_in_run_order(spark):
    steps = spark.createDataFrame([(5, "1", "job-2", 0, "build", "success", "success"), (9, "1", "job-10", 0, "test", "failure", "failure"),
                                   (7, "1", "job-2", 1, "pack", "success", "success")],
                                  "seq long, run_id string, job_name string, step_no int, step_name string, conclusion string, job_conclusion string")
    text = CI.assemble_logs(steps).first().logs
    assert text.index("Job: job-2") < text.index("Step: build") < text.index("Step: pack") < text.index("Job: job-10")
