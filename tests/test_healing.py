"""Every plan rule and file rewrite on literal rows, against plain Python versions of the rules."""

import re

import pytest
from pyspark.sql import functions as F

from runlens.operators import healing as H

A_SCHEMA = ("log_id long, run_id string, repo string, error_type string, error_message string, "
            "missing_package string, test_name string")
C_SCHEMA = "repo string, requirements string, pytest_ini string, workflow string, rollback_sha string"

CASES = [
    # (error_type, message, package, test, requirements, pytest_ini, workflow, rollback) -> (success, details, changes)
    ("npm_dependency_error", "Error: Command failed: npm install", None, None, None, None, None, None,
     (False, "No healing strategy for npm_dependency_error", [])),
    ("missing_dependency", "x", None, None, "a\n", None, None, None, (False, "Could not identify missing package", [])),
    ("missing_dependency", "x", "pandas", None, "pandas==2.0\n", None, None, None, (False, "pandas already in requirements.txt", [])),
    ("missing_dependency", "x", "numpy", None, "requests==2.31.0\n", None, None, None,
     (True, "Added numpy to requirements.txt", ["requirements.txt: +numpy"])),
    ("test_timeout", "x", None, "data_processing", None, "[pytest]\n", None, None,
     (True, "Increased timeout to 300s for data_processing", ["pytest.ini: timeout = 300"])),
    ("test_timeout", "x", None, "slow", None, None, None, None,
     (True, "Created pytest.ini with 300s timeout", ["pytest.ini: created with timeout = 300"])),
    ("flaky_test", "x", None, None, None, None, None, None,
     (True, "Added retry logic (3 retries) for flaky tests", ["requirements.txt: +pytest-rerunfailures", "pytest.ini: --reruns 3"])),
    ("build_failure", "Build step Cache restore failed with exit code 1", None, None, None, None, None, None,
     (True, "Cache cleared, workflow will be re-triggered", ["cache: cleared"])),
    ("build_failure", "Build step x failed with exit code 1: Permission Denied", None, None, None, None, None, None,
     (False, "Permission error requires manual intervention", [])),
    ("build_failure", "Build step compile failed with exit code 2", None, None, None, None, None, None,
     (False, "Build failure type not recognized", [])),
    ("deployment_crash", "Deployment x crashed", None, None, None, None, None, "abcdef1",
     (True, "Rolled back to commit abcdef1", ["deployment: reverted to abcdef1"])),
    ("deployment_crash", "Deployment x crashed", None, None, None, None, None, None,
     (False, "No previous successful deployment found", [])),
    ("resource_limit", "OOMKilled", None, None, None, None, "jobs: {}\n", None,
     (True, "Increased workflow timeout to 60 minutes", ["workflow: timeout-minutes = 60"])),
    ("resource_limit", "OOMKilled", None, None, None, None, None, None,
     (False, f"Could not update workflow: {H.WORKFLOW} not found", [])),
    ("network_timeout", "Connection refused", None, None, None, None, None, None,
     (True, "Added retry-capable HTTP libraries", ["requirements.txt: +requests", "Suggested: Implement retry logic in code"])),
]


def test_plan_rules(spark):
    a = spark.createDataFrame([(i, str(i), f"r{i}", c[0], c[1], c[2], c[3]) for i, c in enumerate(CASES)], A_SCHEMA)
    ctx = spark.createDataFrame([(f"r{i}", c[4], c[5], c[6], c[7]) for i, c in enumerate(CASES)], C_SCHEMA)
    got = {r.log_id: r for r in H.plan_healing(a, ctx).collect()}
    for i, c in enumerate(CASES):
        want = c[8]
        r = got[i]
        assert (r.success, r.details, list(r.changes_made)) == want, (i, c[0])
        assert r.action_type == (c[0] if c[0] in H.STRATEGIES else "none")


def py_requirements(content, pkg):
    cur = content or ""
    return cur if pkg in cur else (cur.strip() + f"\n{pkg}\n").lstrip("\n")


def py_timeout(content):
    if content is None:
        return "[pytest]\ntimeout = 300\n"
    if "timeout" in content:
        return re.sub(r"timeout\s*=\s*\d+", "timeout = 300", content)
    return content + "\n[pytest]\ntimeout = 300\n"


def py_reruns(content):
    if content is None:
        return "[pytest]\naddopts = --reruns 3 --reruns-delay 1\n"
    return content if "--reruns" in content else content + "\naddopts = --reruns 3 --reruns-delay 1\n"


def py_workflow(content):
    return re.sub(r"timeout-minutes:\s*\d+", "timeout-minutes: 60", content) if "timeout-minutes" in content else content


def test_rewrites(spark):
    texts = [None, "", "  requests==2.31.0\n\n", "pkg9\n", "[pytest]\ntimeout = 60\n", "[pytest]\n",
             "timeout=5 and timeout =  7", "x --reruns 2", "jobs:\n  timeout-minutes: 10\n  timeout-minutes:5\n", "jobs: {}\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    rows = df.select("i", H.rewrite_requirements(F.col("c"), F.lit("pkg9")).alias("req"),
                     H.rewrite_pytest_timeout(F.col("c")).alias("to"), H.rewrite_pytest_reruns(F.col("c")).alias("rr"),
                     H.rewrite_workflow_timeout(F.col("c")).alias("wf")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.req == py_requirements(t, "pkg9"), r.i
        assert r.to == py_timeout(t), r.i
        assert r.rr == py_reruns(t), r.i
        if t is not None:
            assert r.wf == py_workflow(t), r.i


def test_vulnerable_dependency_fix(spark):
    files = spark.createDataFrame([("r", "requirements.txt", "requests==2.31.0\npkg1>=1\n\npkg2\n"),
                                   ("r", "pytest.ini", "pkg1\n")], "repo string, path string, content string")
    adv = spark.createDataFrame([("pkg1", "2.0.1"), ("pkg2", None), ("other", "1")], "package string, safe_version string")
    got = {r.package: r for r in H.vulnerable_dependency_fix(files, adv).collect()}
    assert set(got) == {"pkg1", "pkg2"}
    assert got["pkg1"].success and got["pkg1"].details == "Updated pkg1 to 2.0.1" and got["pkg1"].change == "pkg1==2.0.1"
    assert not got["pkg2"].success and got["pkg2"].details == "No safe version available" and got["pkg2"].change is None


def test_percent_format_matches_python(spark):
    vals = [0.0, 0.00125, 0.02675, 0.5, 0.123456, 1.0, 0.99995]
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    got = [r.s for r in df.select(H.percent_format(F.col("p")).alias("s")).collect()]
    assert got == [f"{v:.2%}" for v in vals]


def test_strategies_are_a_registry(spark):
    from runlens.functions.classify import HEALABLE_TYPES
    assert list(H.STRATEGIES) == HEALABLE_TYPES  # what the analysis calls fixable
    kinds = ["lint_failure", "lint_failure", "network_timeout", "other", None]
    a = spark.createDataFrame([(i, str(i), "r", k, "two errors" if i else "one error", None, None) for i, k in enumerate(kinds)],
                              "log_id long, run_id string, repo string, error_type string, error_message string, missing_package string, test_name string")
    context = spark.createDataFrame([("r", None, None, None, None)], "repo string, requirements string, pytest_ini string, workflow string, rollback_sha string")
    lint = lambda f: [H.Rule(f.message.contains("one"), True, "Formatted", ["format: run"]), H.Rule(None, False, f.message)]
    more = H.with_strategy("lint_failure", lint)
    got = [tuple(r) for r in H.plan_healing(a, context, strategies=more).orderBy("log_id").select("success", "action_type", "details", "changes_made").collect()]
    assert got[0] == (True, "lint_failure", "Formatted", ["format: run"])
    assert got[1] == (False, "lint_failure", "two errors", [])
    assert got[2][:2] == (True, "network_timeout")
    assert got[3] == (False, "none", "No healing strategy for other", [])
    assert got[4][0] is False and got[4][3] == []
    assert "lint_failure" not in H.STRATEGIES
    plain = H.plan_healing(a, context).orderBy("log_id").collect()
    assert plain[0].action_type == "none" and plain[0].details == "No healing strategy for lint_failure"
    for bad in (lambda f: [], lambda f: [H.Rule(f.message == "x", True, "x")], lambda f: [H.Rule(None, True, "x"), H.Rule(None, False, "y")]):
        with pytest.raises(ValueError):
            H.plan_healing(a, context, strategies=H.with_strategy("lint_failure", bad))
    with pytest.raises(ValueError):
        H.with_strategy("", lint)


def test_two_packages_are_added_one_after_the_other(spark):
    a = spark.createDataFrame([("network_timeout", None, "requests==2"), ("network_timeout", None, None), ("flaky_test", None, "a\n\n"),
                               ("missing_dependency", "b", "a"), ("missing_dependency", "", "a"), ("unknown", None, "a")],
                              "error_type string, missing_package string, requirements string")
    content = F.aggregate(H.added_packages(), F.coalesce("requirements", F.lit("")), H.rewrite_requirements)
    assert [r[0] for r in a.select(content).collect()] == [
        "requests==2\nurllib3\n", "requests\nurllib3\n", "a\npytest-rerunfailures\n", "a\nb\n", "a", "a"]
