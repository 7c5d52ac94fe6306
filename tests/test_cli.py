from runlens.__main__ import main


def test_list_and_sql(capsys):
    assert main(["list"]) == 0
    out = capsys.readouterr().out.splitlines()
    keys = {line.split("\t")[0] for line in out}
    assert {"failure_patterns_report", "train_failure_model", "stream_webhook_upsert"} <= keys
    assert main(["sql", "failure_rate"]) == 0
    assert "from predictions" in capsys.readouterr().out


def test_run_writes_with_spark(spark, sf, tmp_path):
    out = str(tmp_path / "report")
    assert main(["run", "failure_patterns_report", sf, "--out", out]) == 0
    assert spark.read.parquet(out).count() >= 1
