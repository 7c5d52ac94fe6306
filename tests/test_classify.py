"""Classification of logs written from the patterns, and a brute force over the whole job_logs table that lists
every match and takes the first one in pattern order."""

import re

from pyspark.sql import functions as F

from runlens.functions import classify as C
from runlens.operators import classify_ops as K
from runlens.sources.tables import tables

# category, log, matched text, first group ("" where the pattern has none)
LOGS = [
    ("missing_dependency", "step 4 of 9\nImportError: cannot import name \"quartz\" from basalt", 'ImportError: cannot import name "quartz"', "quartz"),
    ("missing_dependency", "yarn note\nnpm err! 404  'left-mast' is not in the npm registry, sorry", "npm err! 404  'left-mast' is not in the npm registry", "left-mast"),
    ("test_timeout", "suite orbit: Test exceeded 75s timeout, giving up", "Test exceeded 75s timeout", "75"),
    ("test_failure", "error: assertion `depth > 3` failed at line 8", "error: assertion `depth > 3` failed", "depth > 3"),
    ("build_failure", "make: *** [Makefile:12: kernel.o] Error 2\nstop", "make: *** [Makefile:12: kernel.o] Error 2", "2"),
    ("deployment_crash", "probe 3 of 3\nHealth check failed on pod heron", "Health check failed", ""),
    ("resource_limit", "runner 17 says: disk space full", "disk space full", ""),
    ("network_timeout", "dial tcp 203.0.113.9:80: i/o timeout", "dial tcp 203.0.113.9:80: i/o timeout", ""),
    ("configuration_error", "missing required field: no config given", "missing required field: no config", ""),
    # two categories in one log: the one whose patterns come first counts, wherever it stands
    ("build_failure", "Forbidden\nCompilation error near main", "Compilation error", ""),
]


def _logs(spark, texts):
    return spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "log_id long, run_id string, logs string")


def first_of(patterns, text):
    """(place in the list, match) of the least pattern that is found, from all that are."""
    hits = {i: m for i, m in enumerate(re.search(p, text, re.I) for p in patterns) if m is not None}
    return (min(hits), hits[min(hits)]) if hits else (None, None)


ANALYZER = [(category, p) for category, patterns in C.ANALYZER_PATTERNS for p in patterns]
DIFFICULTY = {row[0]: row[1] for row in C.PATTERN_DIM}


def pattern_of(text):
    i, m = first_of([p for _, p in ANALYZER], text)
    if m is None:
        return ("unknown", None, None, "hard")
    return (ANALYZER[i][0], m[0], m[1] if m.re.groups else "", DIFFICULTY[ANALYZER[i][0]])


def analysis_of(text):
    i, m = first_of([p for p, _ in C.ENGINE_PATTERNS], text)
    kind = "unknown" if m is None else C.ENGINE_PATTERNS[i][1]
    group = m[1] if m is not None and m.re.groups else None
    trace = re.search(C.STACK_TRACE_PATTERN, text, re.S)
    return (kind, "" if m is None else m[0], group if kind == "missing_dependency" else None, group if kind == "test_timeout" else None,
            trace[0] if trace else "")


def test_logs_written_from_the_patterns(spark):
    rows = K.identify_pattern(_logs(spark, [log for _, log, _, _ in LOGS])).orderBy("log_id").collect()
    assert [(r.pattern_type, r.matched_text, r.captured_groups) for r in rows] == [(c, m, g) for c, _, m, g in LOGS]
    assert [pattern_of(log)[:3] for _, log, _, _ in LOGS] == [(c, m, g) for c, _, m, g in LOGS]


def test_batch_stats_and_top5(spark):
    p = K.identify_pattern(_logs(spark, [log for _, log, _, _ in LOGS]))
    stats = {r.pattern_type: (r["count"], r.percentage) for r in K.pattern_batch_stats(p).collect()}
    twice = {"missing_dependency", "build_failure"}
    assert stats == {c: (2, 20.0) if c in twice else (1, 10.0) for c, _, _, _ in LOGS}
    top = K.most_common_patterns(p).orderBy("rank").collect()
    assert len(top) == 5 and {r.pattern_type for r in top[:2]} == twice


def test_edge_rows(spark):
    texts = ["", "ModuleNotFoundError: No module named 'a.b'",
             "ERROR: Could not find a version that satisfies the requirement lib==9.9",
             "Could not find a version that satisfies the requirement lib~=1.0", "TimeoutError", "KeyError: 'cfg'"]
    a = {r.log_id: r for r in K.analyze_failure(_logs(spark, texts)).collect()}
    p = {r.log_id: r for r in K.identify_pattern(_logs(spark, texts)).collect()}
    pk = {r.log_id: r.package for r in K.packages(_logs(spark, texts)).collect()}
    assert a[0].error_type == "unknown" and p[0].pattern_type == "unknown" and p[0].difficulty == "hard"
    assert a[1].error_type == "unknown" and p[1].pattern_type == "unknown"  # dotted module is not \w+
    assert a[2].missing_package == "lib==9.9" and pk[2] == "lib"
    assert pk[3] == "lib~"
    assert a[4].error_type == "unknown" and p[4].pattern_type == "test_timeout"  # the two taxonomies differ
    assert p[5].pattern_type == "configuration_error" and p[5].captured_groups == "cfg"


def test_brute_force_over_job_logs(spark, sf):
    t = tables(spark, sf)
    src = {r.log_id: r.logs for r in t.job_logs.select("log_id", "logs").collect()}
    got_p = {r.log_id: (r.pattern_type, r.matched_text, r.captured_groups, r.difficulty)
             for r in K.identify_pattern(t.job_logs).collect()}
    got_a = {r.log_id: r for r in K.analyze_failure(t.job_logs).collect()}
    assert src, "fixture has failure logs"
    for i, text in src.items():
        assert got_p[i] == pattern_of(text or ""), i
        r = got_a[i]
        assert (r.error_type, r.error_message, r.missing_package, r.test_name, r.stack_trace) == analysis_of(text or ""), i


def test_filter_on_error_type_keeps_single_regex_pass(spark, sf):
    a = K.analyze_failure(tables(spark, sf).job_logs).filter(F.col("error_type") == "test_timeout")
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan
    assert a.count() >= 0
