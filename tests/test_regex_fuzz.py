"""Randomised differential test: Spark (Java regex) classifiers vs Python ``re`` on texts built
from pattern fragments, mixed case, quotes, newlines, digits and non-ASCII letters."""

import random

from runlens.functions import classify as C
from runlens.operators import classify_ops as K

from .test_classify import analysis_of, pattern_of

FRAGMENTS = [
    "ModuleNotFoundError: No module named ", "ImportError: cannot import name ", "'", '"', "pandas", "a.b", "lib==9.9",
    "ERROR: Could not find a version that satisfies the requirement ", "FAILED tests/test_x.py::test_", "slow", " - Timeout",
    "Timeout", "AssertionError", "AssertionError: ", "Build step ", "compile", " failed with exit code ", "2",
    "Error: Command failed: npm install", "Deployment ", "crashed", "OOMKilled", "Connection refused", "connection TIMEOUT",
    "dial tcp 1.2.3.4:443: i/o timeout", "npm ERR! 404  'left-pad' is not in the npm registry", "Package 'zz' not found",
    "pytest.timeout.Timeout", "Test exceeded 60s timeout", "TimeoutError", "Error: Assertion `x > 1` failed",
    "Expected 1 but got 2", "ERROR: Build failed", "make: *** [all] Error 3", "Compilation error", "CrashLoopBackOff",
    "Error: Application failed to start", "Health check failed", "OutOfMemoryError", "Resource limit exceeded",
    "Disk space full", "Network is unreachable", "SyntaxError: bad", "IndentationError", "invalid syntax",
    "unexpected token", "PermissionError", "Permission denied", "Access denied", "Forbidden", "Configuration error",
    "Invalid configuration", "Missing required key in config", "KeyError: 'cfg'", "Traceback (most recent call last):",
    "\n", "\n\n", " ", "\t", "ünïcödé", "ß", "x", "_", "test_", "Error in test_abc", "test_q FAILED",
    # non-ASCII letters that case-fold to ASCII pattern letters: these texts skip the literal guard
    "Connection refu\u017fed", "OOM\u212Ailled", "Forb\u0131dden", "Acce\u017f\u017f denied",
]


def _texts(n: int, seed: int = 11) -> list[str]:
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        parts = [rnd.choice(FRAGMENTS) for _ in range(rnd.randint(1, 8))]
        t = "".join(parts)
        if rnd.random() < 0.3:
            t = "".join(ch.upper() if rnd.random() < 0.5 else ch.lower() for ch in t)
        out.append(t)
    return out


def test_classifiers_match_python_re(spark):
    texts = _texts(400)
    df = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "log_id long, run_id string, logs string")
    pats = {r.log_id: r for r in K.identify_pattern(df).collect()}
    eng = {r.log_id: r for r in K.analyze_failure(df).collect()}
    pk = {r.log_id: r.package for r in K.packages(df).collect()}
    tn = {r.log_id: r.test_name for r in K.test_names(df).collect()}
    import re
    for i, t in enumerate(texts):
        assert (pats[i].pattern_type, pats[i].matched_text, pats[i].captured_groups, pats[i].difficulty) == pattern_of(t), t
        r = eng[i]
        assert (r.error_type, r.error_message, r.missing_package, r.test_name, r.stack_trace) == analysis_of(t), t
        want_pkg = None
        for p in C.PACKAGE_PATTERNS:
            m = re.search(p, t)
            if m:
                want_pkg = re.sub(r"[<>=!]+.*", "", m.group(1)).strip()
                break
        assert pk[i] == want_pkg, t
        want_test = "unknown_test"
        for p in C.TEST_NAME_PATTERNS:
            m = re.search(p, t)
            if m:
                want_test = f"test_{m.group(1)}"
                break
        assert tn[i] == want_test, t
