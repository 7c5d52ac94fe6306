"""Registered queries: healing features, gate, plans, rewrites, advisories, signatures, secret
scan and small text formats (P5, P8-P12, F8-F15, J11, S3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import security as SEC
from ..operators import classify_ops as K
from ..operators import healing as H
from ..operators import vcs as V
from ..sources.tables import tables
from .oracle_views import q
from .registry import register

WEBHOOK_SECRET = "runlens-webhook-secret"

SEV_W = " ".join(f"when severity = '{s}' then {w}e0" for s, w in H.SEVERITY_WEIGHTS)


@register("healing_features", f"""
select log_id, run_id, case when fixable then 1e0 else 0e0 end as fixable_f, cast(length(stack_trace) as double) as stack_trace_len,
  case when coalesce(missing_package, '') <> '' then 1e0 else 0e0 end as has_missing_package,
  case {SEV_W} else {H.SEVERITY_WEIGHT_DEFAULT}e0 end as severity_weight, 0.8e0 as constant
from failure_analysis""")
def healing_features(spark, sf):
    return H.healing_features(K.analyze_failure(tables(spark, sf).job_logs))


SCORE = """(previous_failures * 0.15e0 + dependency_changes * 0.12e0 + (commit_size / 1000) * 0.10e0
  + ((100 - test_coverage) / 100) * 0.08e0 + (code_complexity / 30) * 0.07e0)"""
SCORED = f"select *, {SCORE} as failure_score, cast({SCORE} > 0.5e0 as integer) as failure_label from run_features"
PRIOR = ("case when failure_label = 1 then (case when dependency_changes > 0 then 0.85e0 else 0.75e0 end) "
         "- (code_complexity / 30) * 0.1e0 else 0e0 end")


def _scored(t):
    return H.failure_risk_score(t.run_features)


@register("failure_risk_score", f"select id, failure_score, failure_label from ({SCORED}) s")
def failure_risk_score(spark, sf):
    return _scored(tables(spark, sf)).select("id", "failure_score", "failure_label")


@register("healing_prior", f"select id, failure_label, {PRIOR} as healing_prior from ({SCORED}) s")
def healing_prior(spark, sf):
    return H.healing_prior(_scored(tables(spark, sf))).select("id", "failure_label", "healing_prior")


@register("heal_gate", f"""
select id, healing_prior, case when healing_prior > 0.7e0 then 'heal' else 'notify' end as decision
from (select id, failure_label, {PRIOR} as healing_prior from ({SCORED}) s) p where failure_label = 1""")
def heal_gate(spark, sf):
    p = H.healing_prior(_scored(tables(spark, sf))).filter("failure_label = 1")
    return H.heal_gate(p, "healing_prior").select("id", "healing_prior", "decision")


CONF = "least(greatest(failure_score, 0e0), 1e0)"


@register("early_warning", f"""
select id, {CONF} as confidence,
  'Early warning: Pipeline ' || cast(id as varchar) || ' likely to fail (confidence: ' || printf('%.2f', {CONF} * 100) || '%)' as message
from ({SCORED}) s where failure_label = 1""")
def early_warning(spark, sf):
    s = _scored(tables(spark, sf)).select(
        "id", (F.col("failure_label") == 1).alias("will_fail"),
        F.least(F.greatest("failure_score", F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    return H.early_warning(s)


@register("percent_format", f"select id, printf('%.2f', {PRIOR} * 100) || '%' as confidence_text from ({SCORED}) s")
def percent_format(spark, sf):
    p = H.healing_prior(_scored(tables(spark, sf)))
    return p.select("id", H.percent_format(F.col("healing_prior")).alias("confidence_text"))


RATE_BY_TYPE = "select action_type, avg(cast(success as double)) as heal_probability from healing_actions group by action_type"


def _gated(t):
    a = K.analyze_failure(t.job_logs)
    rate = _rates(t)
    j = a.join(rate, a["error_type"] == rate["action_type"], "left")
    return H.heal_gate(j.select("log_id", "run_id", "error_type", "heal_probability"), "heal_probability")


@register("heal_gate_by_type", f"""
select f.log_id, f.run_id, f.error_type, r.heal_probability,
  case when r.heal_probability > 0.7e0 then 'heal' else 'notify' end as decision
from failure_analysis f left join ({RATE_BY_TYPE}) r on f.error_type = r.action_type""")
def heal_gate_by_type(spark, sf):
    return _gated(tables(spark, sf))


def _analysis_with_repo(t, attrs=None):
    """Analysed failures with their run's repository (null when the run is unknown)."""
    attrs = V.run_attributes(t.run_events) if attrs is None else attrs
    return K.analyze_failure(t.job_logs).join(attrs.select("run_id", "repo"), "run_id", "left")


def _rates(t):
    return t.healing_actions.groupBy("action_type").agg(F.avg(F.col("success").cast("double")).alias("heal_probability"))


def _plans(t, with_gate: bool = False):
    attrs = V.run_attributes(t.run_events)
    ctx = H.repo_context(H.repo_file_pivot(t.repo_files), V.last_good_run(attrs))
    return H.plan_healing(_analysis_with_repo(t, attrs), ctx, _rates(t) if with_gate else None)


FILES = f"""select repo, max(case when path = '{H.REQUIREMENTS}' then content end) as requirements,
  max(case when path = '{H.PYTEST_INI}' then content end) as pytest_ini, max(case when path = '{H.WORKFLOW}' then content end) as workflow
from repo_files group by repo"""
RUN_ATTRS = """select r.run_id, r.id, r.repo, r.conclusion, r.created_at, l.head_sha, l.event
from pipeline_runs r join (select run_id, head_sha, event from (
  select *, row_number() over (partition by run_id order by seq desc) as rn from run_events) x where rn = 1) l on r.run_id = l.run_id"""
HEALABLE = ", ".join(q(x) for x in H.STRATEGIES)


def _plan_sql() -> str:
    rules = [
        (f"error_type not in ({HEALABLE})", "false", "'No healing strategy for ' || error_type", "''"),
        ("error_type = 'missing_dependency' and coalesce(missing_package, '') = ''", "false",
         "'Could not identify missing package'", "''"),
        ("error_type = 'missing_dependency' and contains(coalesce(requirements, ''), missing_package)", "false",
         "missing_package || ' already in requirements.txt'", "''"),
        ("error_type = 'missing_dependency'", "true", "'Added ' || missing_package || ' to requirements.txt'",
         "'requirements.txt: +' || missing_package"),
        ("error_type = 'test_timeout' and pytest_ini is not null", "true",
         "'Increased timeout to 300s for ' || coalesce(test_name, 'None')", "'pytest.ini: timeout = 300'"),
        ("error_type = 'test_timeout'", "true", "'Created pytest.ini with 300s timeout'", "'pytest.ini: created with timeout = 300'"),
        ("error_type = 'flaky_test'", "true", "'Added retry logic (3 retries) for flaky tests'",
         "'requirements.txt: +pytest-rerunfailures | pytest.ini: --reruns 3'"),
        ("error_type = 'build_failure' and contains(lower(error_message), 'cache')", "true",
         "'Cache cleared, workflow will be re-triggered'", "'cache: cleared'"),
        ("error_type = 'build_failure' and contains(lower(error_message), 'permission denied')", "false",
         "'Permission error requires manual intervention'", "''"),
        ("error_type = 'build_failure'", "false", "'Build failure type not recognized'", "''"),
        ("error_type = 'deployment_crash' and rollback_sha is not null", "true", "'Rolled back to commit ' || rollback_sha",
         "'deployment: reverted to ' || rollback_sha"),
        ("error_type = 'deployment_crash'", "false", "'No previous successful deployment found'", "''"),
        ("error_type = 'resource_limit' and workflow is not null", "true", "'Increased workflow timeout to 60 minutes'",
         "'workflow: timeout-minutes = 60'"),
        ("error_type = 'resource_limit'", "false", f"'Could not update workflow: {H.WORKFLOW} not found'", "''"),
        ("error_type = 'network_timeout'", "true", "'Added retry-capable HTTP libraries'",
         "'requirements.txt: +requests | Suggested: Implement retry logic in code'"),
    ]
    col = lambda i: "case " + " ".join(f"when {r[0]} then {r[i]}" for r in rules) + " end"
    return f"""
with attrs as ({RUN_ATTRS}),
good as (select repo, head_sha from (select *, row_number() over (partition by repo order by created_at desc, id desc) as rn
         from attrs where event = 'push' and conclusion = 'success') g where rn = 1),
a as (select f.*, r.repo from failure_analysis f left join pipeline_runs r on f.run_id = r.run_id),
j as (select a.*, fl.requirements, fl.pytest_ini, fl.workflow,
        case when a.error_type = 'deployment_crash' then substr(g.head_sha, 1, 7) end as rollback_sha
      from a left join ({FILES}) fl on a.repo = fl.repo left join good g on a.repo = g.repo)
select log_id, run_id, repo, error_type, {col(1)} as success,
  case when error_type in ({HEALABLE}) then error_type else 'none' end as action_type,
  {col(2)} as details, {col(3)} as changes_made
from j"""


@register("plan_healing", _plan_sql())
def plan_healing(spark, sf):
    p = _plans(tables(spark, sf))
    return p.withColumn("changes_made", F.array_join("changes_made", " | "))


@register("notifications", f"""
with gate as (select f.log_id, f.run_id, f.error_type, r.heal_probability,
    case when r.heal_probability > 0.7e0 then 'heal' else 'notify' end as decision
  from failure_analysis f left join ({RATE_BY_TYPE}) r on f.error_type = r.action_type),
plans as ({_plan_sql()})
select gate.* from gate left join plans on gate.log_id = plans.log_id
where gate.decision = 'notify' or not coalesce(plans.success, false)""")
def notifications(spark, sf):
    p = _plans(tables(spark, sf), with_gate=True)
    return H.notifications(p).select("log_id", "run_id", "error_type", "heal_probability", "decision")


def _added_sql(content: str, package: str) -> str:
    """The requirements with a package at their end, unless its name is in them."""
    stripped = f"regexp_replace({content}, '^\\s+|\\s+$', '', 'g')"
    return f"""case when contains({content}, {package}) then {content}
       else regexp_replace({stripped} || chr(10) || {package} || chr(10), '^\\n+', '') end"""


@register("rewrite_requirements", f"""
select log_id, repo, array_to_string(packages, ',') as packages,
  case when len(packages) > 1 then {_added_sql('first_content', 'packages[2]')} else first_content end as new_content
from (select *, {_added_sql("coalesce(requirements, '')", 'packages[1]')} as first_content
  from (select f.log_id, r.repo, fl.requirements, case when f.error_type = 'missing_dependency' then [f.missing_package]
          when f.error_type = 'flaky_test' then ['pytest-rerunfailures'] when f.error_type = 'network_timeout' then ['requests', 'urllib3'] end as packages
        from failure_analysis f left join pipeline_runs r on f.run_id = r.run_id left join ({FILES}) fl on r.repo = fl.repo
        where f.error_type in ('flaky_test', 'network_timeout') or (f.error_type = 'missing_dependency' and coalesce(f.missing_package, '') <> '')) a) b""")
def rewrite_requirements(spark, sf):
    t = tables(spark, sf)
    a = _analysis_with_repo(t).withColumn("packages", H.added_packages()).filter(F.size("packages") > 0)
    j = a.join(H.repo_file_pivot(t.repo_files), "repo", "left")
    content = F.aggregate("packages", F.coalesce("requirements", F.lit("")), H.rewrite_requirements)
    return j.select("log_id", "repo", F.array_join("packages", ",").alias("packages"), content.alias("new_content"))


@register("rewrite_pytest_timeout", f"""
select a.log_id, a.repo,
  case when fl.pytest_ini is null then '[pytest]' || chr(10) || 'timeout = 300' || chr(10)
       when contains(fl.pytest_ini, 'timeout') then regexp_replace(fl.pytest_ini, 'timeout\\s*=\\s*\\d+', 'timeout = 300', 'g')
       else fl.pytest_ini || chr(10) || '[pytest]' || chr(10) || 'timeout = 300' || chr(10) end as new_content
from (select f.*, r.repo from failure_analysis f left join pipeline_runs r on f.run_id = r.run_id) a
left join ({FILES}) fl on a.repo = fl.repo
where a.error_type = 'test_timeout'""")
def rewrite_pytest_timeout(spark, sf):
    t = tables(spark, sf)
    a = _analysis_with_repo(t).filter(F.col("error_type") == "test_timeout")
    j = a.join(H.repo_file_pivot(t.repo_files), "repo", "left")
    return j.select("log_id", "repo", H.rewrite_pytest_timeout(F.col("pytest_ini")).alias("new_content"))


@register("rewrite_pytest_reruns", f"""
select r.full_name as repo,
  case when fl.pytest_ini is null then '[pytest]' || chr(10) || 'addopts = --reruns 3 --reruns-delay 1' || chr(10)
       when contains(fl.pytest_ini, '--reruns') then fl.pytest_ini
       else fl.pytest_ini || chr(10) || 'addopts = --reruns 3 --reruns-delay 1' || chr(10) end as new_content
from repos r left join ({FILES}) fl on r.full_name = fl.repo""")
def rewrite_pytest_reruns(spark, sf):
    t = tables(spark, sf)
    j = t.repos.select(F.col("full_name").alias("repo")).join(H.repo_file_pivot(t.repo_files), "repo", "left")
    return j.select("repo", H.rewrite_pytest_reruns(F.col("pytest_ini")).alias("new_content"))


@register("rewrite_workflow_timeout", """
select repo, case when contains(content, 'timeout-minutes') then regexp_replace(content, 'timeout-minutes:\\s*\\d+', 'timeout-minutes: 60', 'g')
  else content end as new_content
from repo_files where path = '.github/workflows/main.yml'""")
def rewrite_workflow_timeout(spark, sf):
    f = tables(spark, sf).repo_files.filter(F.col("path") == H.WORKFLOW)
    return f.select("repo", H.rewrite_workflow_timeout(F.col("content")).alias("new_content"))


@register("vulnerable_dependency_fix", """
with lines as (select repo, trim(regexp_replace(line, '[<>=!~;\\[ ].*', '')) as package
  from (select repo, unnest(string_split(content, chr(10))) as line from repo_files where path = 'requirements.txt') x)
select l.repo, l.package, a.safe_version, a.safe_version is not null as success,
  case when a.safe_version is not null then 'Updated ' || l.package || ' to ' || a.safe_version else 'No safe version available' end as details,
  case when a.safe_version is not null then l.package || '==' || a.safe_version end as change
from lines l join advisories a on l.package = a.package where l.package <> ''""")
def vulnerable_dependency_fix(spark, sf):
    t = tables(spark, sf)
    return H.vulnerable_dependency_fix(t.repo_files, t.advisories)


def _hmac_sql(secret: str) -> str:
    ipad, opad = SEC.hmac_pads(secret)
    return (f"'sha256=' || sha256(unhex('{opad}') || unhex(sha256(unhex('{ipad}') || encode(payload))))")


@register("webhook_verify", f"select delivery_id, {_hmac_sql(WEBHOOK_SECRET)} as signature from webhooks")
def webhook_verify(spark, sf):
    w = tables(spark, sf).webhooks
    return w.select("delivery_id", SEC.signature_of(F.col("payload"), WEBHOOK_SECRET).alias("signature"))


def _kw_sql() -> str:
    parts = ", ".join(f"case when regexp_matches(text, {q(SEC.keyword_pattern(k))}) then '{k}' end" for k in SEC.SECRET_KEYWORDS)
    return f"concat_ws(',', {parts})"


def _signed(w):
    """Deliveries with the signature header they came with: the right one, none, or one of another payload."""
    n, right = F.col("delivery_id") % 4, SEC.signature_of(F.col("payload"), WEBHOOK_SECRET)
    header = F.when(n == 1, "").when(n == 2, SEC.signature_of(F.concat("payload", F.lit(" ")), WEBHOOK_SECRET)).when(n == 3, F.upper(right)).otherwise(right)
    return w.withColumn("signature", header)


@register("webhook_verdict", "select delivery_id, delivery_id % 4 = 0 as accepted from webhooks")
def webhook_verdict(spark, sf):
    w = _signed(tables(spark, sf).webhooks)
    return w.select("delivery_id", SEC.verify_signature(F.col("payload"), F.col("signature"), WEBHOOK_SECRET).alias("accepted"))


@register("secret_scan", f"""
select doc_id, {_kw_sql()} as keywords, len(regexp_extract_all(text, {q(SEC.masked_pattern(possessive=False))})) as n_secrets from documents""")
def secret_scan(spark, sf):
    d = tables(spark, sf).documents.select("doc_id", "text", F.lower("text").alias("_low"))
    t, low = F.col("text"), F.col("_low")
    return d.select("doc_id", F.array_join(SEC.found_keywords(t, low), ",").alias("keywords"),
                    SEC.count_assignments(t, low).cast("bigint").alias("n_secrets"))


@register("secret_redact", f"""
select doc_id, regexp_replace(text, {q(SEC.masked_pattern(possessive=False))}, '\\1\\2\\3***', 'g') as redacted from documents""")
def secret_redact(spark, sf):
    d = tables(spark, sf).documents
    return d.select("doc_id", SEC.redact(F.col("text")).alias("redacted"))


@register("short_sha", "select sha, substr(sha, 1, 7) as short_sha from commits")
def short_sha(spark, sf):
    return tables(spark, sf).commits.select("sha", F.substring("sha", 1, 7).alias("short_sha"))
