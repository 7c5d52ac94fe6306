"""Registered queries: log classification."""

from __future__ import annotations


from ..functions import classify as C
from ..operators import classify_ops as K
from ..sources.tables import tables
from .oracle_views import STACK_SQL, _case_index, _case_value, _extract, q
from .registry import register


@register("analyze_failure", """
select log_id, run_id, created_at, error_type, error_message, fixable, missing_package, test_name, stack_trace, severity
from failure_analysis""")
def analyze_failure(spark, sf):
    return K.analyze_failure(tables(spark, sf).job_logs)


@register("identify_pattern", """
select log_id, run_id, created_at, pattern_type, matched_text, captured_groups, difficulty from log_patterns""")
def identify_pattern(spark, sf):
    return K.identify_pattern(tables(spark, sf).job_logs)


def _package_sql() -> str:
    k = _case_index("logs", C.PACKAGE_PATTERNS, False)
    raw = _case_value("k", [_extract("logs", p, 1, False) for p in C.PACKAGE_PATTERNS])
    return (f"select log_id, run_id, created_at, trim(regexp_replace({raw}, {q(C.VERSION_SPEC_PATTERN)}, '')) as package "
            f"from (select *, {k} as k from job_logs) x")


def _test_name_sql() -> str:
    k = _case_index("logs", C.TEST_NAME_PATTERNS, False)
    raw = _case_value("k", [_extract("logs", p, 1, False) for p in C.TEST_NAME_PATTERNS])
    return (f"select log_id, run_id, created_at, coalesce('test_' || {raw}, 'unknown_test') as test_name "
            f"from (select *, {k} as k from job_logs) x")


@register("extract_package", _package_sql())
def extract_package(spark, sf):
    return K.packages(tables(spark, sf).job_logs)


@register("extract_test_name", _test_name_sql())
def extract_test_name(spark, sf):
    return K.test_names(tables(spark, sf).job_logs)


@register("stack_trace", f"select log_id, run_id, created_at, {STACK_SQL} as stack_trace from job_logs")
def stack_trace(spark, sf):
    return K.stack_traces(tables(spark, sf).job_logs)


@register("severity", "select log_id, error_type, severity from failure_analysis")
def severity(spark, sf):
    return K.severities(K.analyze_failure(tables(spark, sf).job_logs))


@register("strategy_lookup", """
select p.log_id, p.pattern_type, coalesce(d.strategy, 'manual_intervention') as strategy,
  coalesce(d.difficulty, 'unknown') as difficulty, coalesce(d.fix_seconds, 0) as fix_seconds,
  coalesce(d.auto_healable, false) as auto_healable
from log_patterns p left join pattern_dim d on p.pattern_type = d.pattern_type""")
def strategy_lookup(spark, sf):
    return K.strategy_lookup(K.identify_pattern(tables(spark, sf).job_logs))


@register("pattern_batch_stats", """
select pattern_type, count, count / sum(count) over () * 100 as percentage, cast(sum(count) over () as bigint) as total_failures,
  coalesce((select difficulty from pattern_dim d where d.pattern_type = g.pattern_type), 'unknown') as difficulty
from (select pattern_type, count(*) as count from log_patterns group by pattern_type) g""")
def pattern_batch_stats(spark, sf):
    return K.pattern_batch_stats(K.identify_pattern(tables(spark, sf).job_logs))


@register("most_common_patterns", """
select rank, pattern_type, count from (
  select pattern_type, count, cast(row_number() over (order by count desc, first_seen) as integer) as rank
  from (select pattern_type, count(*) as count, min(log_id) as first_seen from log_patterns group by pattern_type) g) r
where rank <= 5""")
def most_common_patterns(spark, sf):
    return K.most_common_patterns(K.identify_pattern(tables(spark, sf).job_logs))


@register("failure_type_distribution", """
select error_type, failures, failures / sum(failures) over () * 100 as percent
from (select error_type, count(*) as failures from failure_logs group by error_type) g""")
def failure_type_distribution(spark, sf):
    return K.failure_type_distribution(tables(spark, sf).failure_logs)
