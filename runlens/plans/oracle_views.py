"""DuckDB-side helpers for the oracle SQL: the FIXTURES views as CTEs plus SQL forms of the
classifiers, built from the same fixed pattern lists the Spark operators use.

DuckDB's regex engine is RE2 (no look-ahead); the stack trace is taken with ``strpos`` and
``split_part`` instead.
"""

from __future__ import annotations

import re

from ..functions import classify as C
from ..sources.views_sql import VIEWS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _case_index(text: str, patterns: list[str], ignore_case: bool) -> str:
    flag = "(?i)" if ignore_case else ""
    whens = " ".join(f"when regexp_matches({text}, {q(flag + p)}) then {i + 1}" for i, p in enumerate(patterns))
    return f"case {whens} end"


def _case_value(k: str, values: list[str | None], default: str = "null") -> str:
    whens = " ".join(f"when {i + 1} then {v}" for i, v in enumerate(values) if v is not None)
    return f"case {k} {whens} else {default} end" if whens else default


def _extract(text: str, p: str, g: int, ignore_case: bool) -> str:
    flag = "(?i)" if ignore_case else ""
    return f"regexp_extract({text}, {q(flag + p)}, {g})"


STACK_SQL = ("case when strpos(logs, 'Traceback (most recent call last):') > 0 then "
             "split_part(substr(logs, strpos(logs, 'Traceback (most recent call last):')), chr(10) || chr(10), 1) end")


def failure_analysis_sql() -> str:
    pats = [p for p, _ in C.ENGINE_PATTERNS]
    types = [t for _, t in C.ENGINE_PATTERNS]
    t = "coalesce(logs, '')"
    k = _case_index(t, pats, True)
    etype = _case_value("k", [q(x) for x in types], "'unknown'")
    msg = _case_value("k", [_extract(t, p, 0, True) for p in pats], "''")
    pkg = _case_value("k", [_extract(t, p, 1, True) if ty == "missing_dependency" and re.compile(p).groups else None
                            for p, ty in C.ENGINE_PATTERNS])
    test = _case_value("k", [_extract(t, p, 1, True) if ty == "test_timeout" and re.compile(p).groups else None
                             for p, ty in C.ENGINE_PATTERNS])
    healable = ", ".join(q(x) for x in C.HEALABLE_TYPES)
    crit = ", ".join(q(x) for x in C.CRITICAL_TYPES)
    high = ", ".join(q(x) for x in C.HIGH_TYPES)
    return f"""select log_id, run_id, created_at, error_type, error_message, error_type in ({healable}) as fixable,
  missing_package, test_name, coalesce({STACK_SQL}, '') as stack_trace,
  case when error_type in ({crit}) then 'critical' when error_type in ({high}) then 'high' else 'medium' end as severity
from (select *, {etype} as error_type, {msg} as error_message, {pkg} as missing_package, {test} as test_name
      from (select *, {k} as k from job_logs) x0) x1"""


def log_patterns_sql() -> str:
    flat = [(cat, p) for cat, pats in C.ANALYZER_PATTERNS for p in pats]
    t = "coalesce(logs, '')"
    k = _case_index(t, [p for _, p in flat], True)
    ptype = _case_value("k", [q(c) for c, _ in flat], "'unknown'")
    matched = _case_value("k", [_extract(t, p, 0, True) for _, p in flat])
    groups = _case_value("k", [_extract(t, p, 1, True) if re.compile(p).groups else "''" for _, p in flat])
    diff = " ".join(f"when pattern_type = {q(c)} then {q(d)}" for c, d, *_ in C.PATTERN_DIM)
    return f"""select log_id, run_id, created_at, pattern_type, matched_text, captured_groups,
  case {diff} else 'hard' end as difficulty
from (select *, {ptype} as pattern_type, {matched} as matched_text, {groups} as captured_groups
      from (select *, {k} as k from job_logs) x0) x1"""


def failure_logs_sql() -> str:
    return ("select log_id as id, run_id, error_type, error_message, stack_trace, 'medium' as severity, created_at "
            "from failure_analysis")


def pattern_dim_sql() -> str:
    rows = " union all ".join(
        f"select {q(c)} as pattern_type, {q(d)} as difficulty, {q(s)} as strategy, {sec} as fix_seconds, {str(a).lower()} as auto_healable"
        for c, d, s, sec, a in C.PATTERN_DIM)
    return rows


ORACLE_VIEWS: dict[str, str] = dict(VIEWS)
ORACLE_VIEWS["failure_analysis"] = failure_analysis_sql()
ORACLE_VIEWS["failure_logs"] = failure_logs_sql()
ORACLE_VIEWS["log_patterns"] = log_patterns_sql()
ORACLE_VIEWS["pattern_dim"] = pattern_dim_sql()


def _deps(sql: str) -> list[str]:
    return [n for n in ORACLE_VIEWS if re.search(rf"\b{n}\b", sql)]


def with_views(body: str) -> str:
    """Prefix ``body`` with the CTEs it (transitively) needs, in dependency order."""
    need: set[str] = set()
    stack = _deps(body)
    while stack:
        n = stack.pop()
        if n in need:
            continue
        need.add(n)
        stack.extend(d for d in _deps(ORACLE_VIEWS[n]) if d != n)
    order = [n for n in ORACLE_VIEWS if n in need]
    if not order:
        return body
    ctes = ",\n".join(f"{n} as (\n{ORACLE_VIEWS[n]}\n)" for n in order)
    stripped = body.lstrip()
    if stripped[:5].lower() == "with ":
        return f"with {ctes},\n{stripped[5:]}"
    return f"with {ctes}\n{body}"
