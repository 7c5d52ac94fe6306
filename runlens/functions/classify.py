"""Failure-log classification as column expressions (F1-F6, J8 dimension values).

Two taxonomies exist side by side on purpose: the healing engine's short list (10 regexes,
11 outcomes with ``unknown``) and the analyzer's long list (41 regexes in 10 categories).
Both are applied first-match in list order, ignoring case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import first_match_index, group_count, java_regex, pick

# ---------------------------------------------------------------------------------------------
# These lists and tables must equal the monitored system's own definitions for the
# results to agree. Order is part of the semantics (first match wins).
# ---------------------------------------------------------------------------------------------

# Healing-engine taxonomy: (pattern, error_type), searched ignoring case.
ENGINE_PATTERNS = [
    (r"ModuleNotFoundError: No module named '(\w+)'", "missing_dependency"),
    (r"ImportError: cannot import name '(\w+)'", "missing_dependency"),
    (r"ERROR: Could not find a version that satisfies the requirement (\S+)", "missing_dependency"),
    (r"FAILED.*test_(\w+).*Timeout", "test_timeout"),
    (r"AssertionError", "test_failure"),
    (r"Build step.*failed with exit code (\d+)", "build_failure"),
    (r"Error: Command failed: npm install", "npm_dependency_error"),
    (r"Deployment.*crashed", "deployment_crash"),
    (r"OOMKilled", "resource_limit"),
    (r"Connection refused|Connection timeout", "network_timeout"),
]

# Error types that have a healing strategy (the engine's registry); others are not fixable.
HEALABLE_TYPES = [
    "missing_dependency",
    "test_timeout",
    "flaky_test",
    "build_failure",
    "deployment_crash",
    "resource_limit",
    "network_timeout",
]

# Severity by error type; everything else is "medium".
CRITICAL_TYPES = ["deployment_crash", "resource_limit"]
HIGH_TYPES = ["missing_dependency", "build_failure"]

# Stack trace: from the header lazily up to the first blank line or the end, case-sensitive,
# dot matches newline.
STACK_TRACE_PATTERN = r"Traceback \(most recent call last\):.*?(?=\n\n|\Z)"

# Analyzer taxonomy: category -> patterns, searched ignoring case, categories in this order.
ANALYZER_PATTERNS = [
    ("missing_dependency", [
        r"ModuleNotFoundError: No module named ['\"](\w+)['\"]",
        r"ImportError: cannot import name ['\"](\w+)['\"]",
        r"ERROR: Could not find a version that satisfies the requirement (\S+)",
        r"npm ERR! 404  '(\S+)' is not in the npm registry",
        r"Package ['\"](\w+)['\"] not found",
    ]),
    ("test_timeout", [
        r"FAILED.*test_(\w+).*Timeout",
        r"pytest\.timeout\.Timeout",
        r"Test exceeded (\d+)s timeout",
        r"TimeoutError",
    ]),
    ("test_failure", [
        r"AssertionError: (.+)",
        r"FAILED.*test_(\w+)",
        r"Error: Assertion `(.+)` failed",
        r"Expected .+ but got .+",
    ]),
    ("build_failure", [
        r"Build step.*failed with exit code (\d+)",
        r"ERROR: Build failed",
        r"make: \*\*\* \[.*\] Error (\d+)",
        r"Compilation error",
    ]),
    ("deployment_crash", [
        r"Deployment.*crashed",
        r"CrashLoopBackOff",
        r"Error: Application failed to start",
        r"Health check failed",
    ]),
    ("resource_limit", [
        r"OOMKilled",
        r"OutOfMemoryError",
        r"Resource limit exceeded",
        r"Disk space full",
    ]),
    ("network_timeout", [
        r"Connection refused",
        r"Connection timeout",
        r"dial tcp.*timeout",
        r"Network is unreachable",
    ]),
    ("syntax_error", [
        r"SyntaxError: (.+)",
        r"IndentationError",
        r"invalid syntax",
        r"unexpected token",
    ]),
    ("permission_error", [
        r"PermissionError",
        r"Permission denied",
        r"Access denied",
        r"Forbidden",
    ]),
    ("configuration_error", [
        r"Configuration error",
        r"Invalid configuration",
        r"Missing required.*config",
        r"KeyError: ['\"](\w+)['\"]",
    ]),
]

# Per analyzer category: difficulty, strategy, estimated fix seconds, auto-healable.
PATTERN_DIM = [
    ("missing_dependency", "easy", "add_to_requirements", 60, True),
    ("test_timeout", "easy", "increase_timeout", 30, True),
    ("test_failure", "medium", "analyze_and_fix", 120, False),
    ("build_failure", "medium", "clear_cache_and_retry", 90, True),
    ("deployment_crash", "medium", "rollback", 180, True),
    ("resource_limit", "easy", "increase_resources", 45, True),
    ("network_timeout", "easy", "add_retry", 30, True),
    ("syntax_error", "hard", "manual_intervention", 0, False),
    ("permission_error", "hard", "manual_intervention", 0, False),
    ("configuration_error", "medium", "validate_config", 60, False),
]

# Package-name extraction (case-sensitive), then strip a version spec.
PACKAGE_PATTERNS = [
    r"ModuleNotFoundError: No module named ['\"](\w+)['\"]",
    r"ImportError: cannot import name ['\"](\w+)['\"]",
    r"Could not find a version that satisfies the requirement (\S+)",
    r"npm ERR! 404  '(\S+)' is not in",
]
VERSION_SPEC_PATTERN = r"[<>=!]+.*"

# Test-name extraction (case-sensitive); result is "test_" + group, else "unknown_test".
TEST_NAME_PATTERNS = [
    r"FAILED.*test_(\w+)",
    r"test_(\w+).*FAILED",
    r"Error in test_(\w+)",
]

# ---------------------------------------------------------------------------------------------


def _java(patterns: list[str], ignore_case: bool) -> list[str]:
    return [java_regex(p, ignore_case) for p in patterns]


def severity_of(error_type: Column) -> Column:
    return (F.when(error_type.isin(CRITICAL_TYPES), "critical")
            .when(error_type.isin(HIGH_TYPES), "high")
            .otherwise("medium"))


def stack_trace_of(text: Column) -> Column:
    """Stack trace text, or null when the log has none."""
    return F.nullif(F.regexp_extract(text, java_regex(STACK_TRACE_PATTERN, dotall=True), 0), F.lit(""))


# Each classifier is two steps: ``*_index(text)`` gives the 1-based index of the first matching
# pattern and should be materialised as its own column; ``*_fields(text, index)`` then reads
# values with one extraction of the chosen pattern. Keeping the index a column (not an inlined
# expression) means each row runs the pattern list once.

def engine_index(text: Column) -> Column:
    return first_match_index(text, _java([p for p, _ in ENGINE_PATTERNS], True))


def engine_fields(text: Column, idx: Column) -> list[Column]:
    """error_type, error_message, missing_package, test_name, stack_trace (F1)."""
    java = _java([p for p, _ in ENGINE_PATTERNS], True)
    error_type = F.coalesce(pick(idx, [F.lit(t) for _, t in ENGINE_PATTERNS]), F.lit("unknown"))
    message = F.coalesce(pick(idx, [F.regexp_extract(text, j, 0) for j in java]), F.lit(""))
    package = pick(idx, [F.regexp_extract(text, j, 1) if t == "missing_dependency" and group_count(p) else None
                         for (p, t), j in zip(ENGINE_PATTERNS, java)])
    test = pick(idx, [F.regexp_extract(text, j, 1) if t == "test_timeout" and group_count(p) else None
                      for (p, t), j in zip(ENGINE_PATTERNS, java)])
    return [error_type.alias("error_type"), message.alias("error_message"), package.alias("missing_package"),
            test.alias("test_name"), F.coalesce(stack_trace_of(text), F.lit("")).alias("stack_trace")]


def _analyzer_flat() -> list[tuple[str, str]]:
    return [(cat, p) for cat, pats in ANALYZER_PATTERNS for p in pats]


def analyzer_index(text: Column) -> Column:
    return first_match_index(text, _java([p for _, p in _analyzer_flat()], True))


def analyzer_fields(text: Column, idx: Column) -> list[Column]:
    """pattern_type, matched_text, captured_groups (F2); difficulty comes from ``difficulty_of``."""
    flat = _analyzer_flat()
    java = _java([p for _, p in flat], True)
    ptype = F.coalesce(pick(idx, [F.lit(c) for c, _ in flat]), F.lit("unknown"))
    matched = pick(idx, [F.regexp_extract(text, j, 0) for j in java])
    groups = pick(idx, [F.regexp_extract(text, j, 1) if group_count(p) else F.lit("")
                        for (_, p), j in zip(flat, java)])
    return [ptype.alias("pattern_type"), matched.alias("matched_text"), groups.alias("captured_groups")]


def difficulty_of(pattern_type: Column, unknown: str = "unknown") -> Column:
    """Difficulty by category through a literal map lookup (one expression, no CASE chain)."""
    m = F.create_map(*[x for c, d, *_ in PATTERN_DIM for x in (F.lit(c), F.lit(d))])
    return F.coalesce(m[pattern_type], F.lit(unknown))


def extract_package(text: Column) -> Column:
    """F3. Expects a cheap ``text`` column reference."""
    java = _java(PACKAGE_PATTERNS, False)
    idx = first_match_index(text, java)
    raw = pick(idx, [F.regexp_extract(text, j, 1) for j in java])
    return F.trim(F.regexp_replace(raw, java_regex(VERSION_SPEC_PATTERN), ""))


def extract_test_name(text: Column) -> Column:
    """F4. Expects a cheap ``text`` column reference."""
    java = _java(TEST_NAME_PATTERNS, False)
    idx = first_match_index(text, java)
    raw = pick(idx, [F.regexp_extract(text, j, 1) for j in java])
    return F.coalesce(F.concat(F.lit("test_"), raw), F.lit("unknown_test"))
