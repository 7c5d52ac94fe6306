"""Healing planning as data: features, gate, the plan per failure, file rewrites, advisories
(P5, P9-P12, F8-F12, J11).

The service applies strategies one failure at a time through remote calls. Here each strategy
is a column rule over the failure's analysis joined to its repository's files, so the plan of
every failure comes out of one projection; nothing is written to a remote system.
Repository files are pivoted to one row per repository and joined on ``repo`` (AQE turns this
into a broadcast join only when the measured file table is under the broadcast threshold).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex import java_regex

# File names, rewrite patterns and texts the strategies use.
REQUIREMENTS = "requirements.txt"
PYTEST_INI = "pytest.ini"
WORKFLOW = ".github/workflows/main.yml"
PYTEST_TIMEOUT_PATTERN = r"timeout\s*=\s*\d+"
PYTEST_TIMEOUT_VALUE = "timeout = 300"
PYTEST_TIMEOUT_SECTION = "\n[pytest]\ntimeout = 300\n"
PYTEST_TIMEOUT_NEW_FILE = "[pytest]\ntimeout = 300\n"
RERUNS_LINE = "\naddopts = --reruns 3 --reruns-delay 1\n"
RERUNS_NEW_FILE = "[pytest]\naddopts = --reruns 3 --reruns-delay 1\n"
WORKFLOW_TIMEOUT_PATTERN = r"timeout-minutes:\s*\d+"
WORKFLOW_TIMEOUT_VALUE = "timeout-minutes: 60"
HEAL_THRESHOLD = 0.70
# Weights of the healing features and of the risk score and prior.
SEVERITY_WEIGHTS = [("critical", 1.0), ("high", 0.8), ("medium", 0.5)]
SEVERITY_WEIGHT_DEFAULT = 0.3
HEALING_FEATURE_CONSTANT = 0.8


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: leading and trailing whitespace."""
    return F.regexp_replace(c, java_regex(r"^\s+|\s+$"), "")


# ---------------------------------------------------------------------------------------------
# P5, P9, P10-P12
# ---------------------------------------------------------------------------------------------

def healing_features(analysis: DataFrame) -> DataFrame:
    """P5: the five healing features of each analysed failure."""
    w = F.lit(SEVERITY_WEIGHT_DEFAULT)
    for sev, weight in reversed(SEVERITY_WEIGHTS):
        w = F.when(F.col("severity") == sev, F.lit(weight)).otherwise(w)
    return analysis.select(
        "log_id", "run_id",
        F.when(F.col("fixable"), 1.0).otherwise(0.0).alias("fixable_f"),
        F.length(F.coalesce("stack_trace", F.lit(""))).cast("double").alias("stack_trace_len"),
        F.when(F.coalesce(F.col("missing_package"), F.lit("")) != "", 1.0).otherwise(0.0).alias("has_missing_package"),
        w.alias("severity_weight"),
        F.lit(HEALING_FEATURE_CONSTANT).alias("constant"),
    )


def failure_risk_score(features: DataFrame) -> DataFrame:
    """Weighted failure score and its label (score > 0.5), without the noise term."""
    score = (F.col("previous_failures") * 0.15 + F.col("dependency_changes") * 0.12
             + (F.col("commit_size") / 1000) * 0.10 + ((100 - F.col("test_coverage")) / 100) * 0.08
             + (F.col("code_complexity") / 30) * 0.07)
    return features.withColumn("failure_score", score).withColumn("failure_label", (score > 0.5).cast("int"))


def healing_prior(scored: DataFrame) -> DataFrame:
    """Prior healing success of failed rows: 0.85 with dependency changes else 0.75, minus
    0.1 x complexity / 30; 0 for rows that did not fail."""
    p = F.when(F.col("dependency_changes") > 0, 0.85).otherwise(0.75) - (F.col("code_complexity") / 30) * 0.1
    return scored.withColumn("healing_prior", F.when(F.col("failure_label") == 1, p).otherwise(F.lit(0.0)))


def heal_gate(df: DataFrame, probability: str, threshold: float = HEAL_THRESHOLD) -> DataFrame:
    """P10: ``heal`` when the probability is above the threshold (strict), else ``notify``."""
    p = F.col(probability)
    return df.withColumn("decision", F.when(p.isNotNull() & (p > threshold), "heal").otherwise("notify"))


def early_warning(predictions: DataFrame, id_col: str = "id") -> DataFrame:
    """Warning text for runs predicted to fail, confidence as a percent with 2 decimals."""
    w = predictions.filter(F.col("will_fail"))
    return w.select(id_col, "confidence", F.format_string(
        "Early warning: Pipeline %s likely to fail (confidence: %s)", F.col(id_col).cast("string"),
        percent_format(F.col("confidence"))).alias("message"))


def percent_format(p: Column) -> Column:
    """probability as ``{:.2%}`` text. ``format_number`` rounds half-even on the exact binary
    value, like Python's formatting (``format_string('%.2f')`` would round the shortest decimal
    form half-up and differ on values such as 2.675)."""
    return F.concat(F.regexp_replace(F.format_number(p * 100, 2), ",", ""), F.lit("%"))


def notifications(gated_plans: DataFrame) -> DataFrame:
    """Failures that were not healed: the gate said notify, or the healing was unsuccessful.
    Input: ``plan_healing(..., rates)`` (plan and gate per failure)."""
    return gated_plans.filter((F.col("decision") == "notify") | ~F.coalesce(F.col("success"), F.lit(False)))


# ---------------------------------------------------------------------------------------------
# F8 plan
# ---------------------------------------------------------------------------------------------

def repo_file_pivot(repo_files: DataFrame) -> DataFrame:
    """One row per repository with the three files the strategies read (null = absent)."""
    pick = lambda path: F.max(F.when(F.col("path") == path, F.col("content")))
    return repo_files.groupBy("repo").agg(
        pick(REQUIREMENTS).alias("requirements"), pick(PYTEST_INI).alias("pytest_ini"), pick(WORKFLOW).alias("workflow"))


def repo_context(files: DataFrame, last_good: DataFrame) -> DataFrame:
    """One row per repository: its three files and the commit of its newest good run (the
    rollback target). Both inputs are per-repository tables, so this is small and joined once."""
    g = last_good.select("repo", F.substring("head_sha", 1, 7).alias("rollback_sha"))
    return files.join(g, "repo", "full_outer")


@dataclass(frozen=True)
class Rule:
    """One outcome of a strategy. ``when`` is None in a strategy's last rule, which takes what is left."""
    when: Column | None
    success: bool
    details: Column | str
    changes: list[Column | str] = field(default_factory=list)


class Facts:
    """What a strategy may look at: an analysed failure and its repository's files, as columns."""

    def __init__(self):
        self.package, self.message, self.test = F.col("missing_package"), F.lower(F.col("error_message")), F.coalesce("test_name", F.lit("None"))
        self.requirements = F.coalesce(F.col("requirements"), F.lit(""))
        self.pytest_ini, self.workflow, self.rollback_sha = F.col("pytest_ini"), F.col("workflow"), F.col("rollback_sha")


Strategy = Callable[[Facts], list[Rule]]


def add_package(f: Facts) -> list[Rule]:
    return [Rule(F.coalesce(f.package, F.lit("")) == "", False, "Could not identify missing package"),
            Rule(f.requirements.contains(f.package), False, F.concat(f.package, F.lit(" already in requirements.txt"))),
            Rule(None, True, F.concat(F.lit("Added "), f.package, F.lit(" to requirements.txt")),
                 [F.concat(F.lit("requirements.txt: +"), f.package)])]


def raise_test_timeout(f: Facts) -> list[Rule]:
    return [Rule(f.pytest_ini.isNotNull(), True, F.concat(F.lit("Increased timeout to 300s for "), f.test), ["pytest.ini: timeout = 300"]),
            Rule(None, True, "Created pytest.ini with 300s timeout", ["pytest.ini: created with timeout = 300"])]


def retry_flaky_test(f: Facts) -> list[Rule]:
    return [Rule(None, True, "Added retry logic (3 retries) for flaky tests", ["requirements.txt: +pytest-rerunfailures", "pytest.ini: --reruns 3"])]


def mend_build(f: Facts) -> list[Rule]:
    return [Rule(f.message.contains("cache"), True, "Cache cleared, workflow will be re-triggered", ["cache: cleared"]),
            Rule(f.message.contains("permission denied"), False, "Permission error requires manual intervention"),
            Rule(None, False, "Build failure type not recognized")]


def roll_back(f: Facts) -> list[Rule]:
    return [Rule(f.rollback_sha.isNotNull(), True, F.concat(F.lit("Rolled back to commit "), f.rollback_sha),
                 [F.concat(F.lit("deployment: reverted to "), f.rollback_sha)]),
            Rule(None, False, "No previous successful deployment found")]


def raise_limits(f: Facts) -> list[Rule]:
    return [Rule(f.workflow.isNotNull(), True, "Increased workflow timeout to 60 minutes", ["workflow: timeout-minutes = 60"]),
            Rule(None, False, f"Could not update workflow: {WORKFLOW} not found")]


def retry_network(f: Facts) -> list[Rule]:
    return [Rule(None, True, "Added retry-capable HTTP libraries", ["requirements.txt: +requests", "Suggested: Implement retry logic in code"])]


#: 2.12: the strategy of each error type; a caller's own types are added with ``with_strategy``.
STRATEGIES: dict[str, Strategy] = {
    "missing_dependency": add_package,
    "test_timeout": raise_test_timeout,
    "flaky_test": retry_flaky_test,
    "build_failure": mend_build,
    "deployment_crash": roll_back,
    "resource_limit": raise_limits,
    "network_timeout": retry_network,
}


def with_strategy(error_type: str, strategy: Strategy, strategies: dict[str, Strategy] = STRATEGIES) -> dict[str, Strategy]:
    """``strategies`` and one more, or another for a type they have; theirs stay as they are."""
    if not error_type:
        raise ValueError("a strategy needs an error type")
    return {**strategies, error_type: strategy}


def _rules(strategies: dict[str, Strategy]) -> list[tuple[str, Rule]]:
    """All rules with their type, checked: each strategy has rules, and its last one and no other is unconditional."""
    out = []
    for kind, strategy in strategies.items():
        rules = strategy(Facts())
        if not rules or [r.when is None for r in rules] != [False] * (len(rules) - 1) + [True]:
            raise ValueError(f"the strategy of {kind} must end with its only rule without a condition")
        out += [(kind, r) for r in rules]
    return out


def plan_healing(analysis: DataFrame, context: DataFrame, rates: DataFrame | None = None,
                 strategies: dict[str, Strategy] = STRATEGIES) -> DataFrame:
    """F8: the plan of every analysed failure (``log_id, run_id, repo, error_type, error_message,
    missing_package, test_name``): success, action type, details and changes, from one chain over the rules of all
    ``strategies``; a type without one is not healed.

    ``context`` is ``repo_context`` (files + rollback target per repository). With ``rates``
    (``action_type, heal_probability``) the gate decision (P10) is added in the same pass, so
    the plan and the gate come from one evaluation of the analysis.
    """
    j = analysis.join(context, "repo", "left")
    extra = []
    if rates is not None:
        j = j.join(rates, j["error_type"] == rates["action_type"], "left").drop("action_type")
        p = F.col("heal_probability")
        extra = [p, F.when(p.isNotNull() & (p > HEAL_THRESHOLD), "heal").otherwise("notify").alias("decision")]
    et, rules = F.col("error_type"), _rules(strategies)
    lit = lambda x: F.lit(x) if isinstance(x, str) else x

    def chain(value: Callable[[Rule], Column], otherwise: Column) -> Column:
        out = F.when(F.lit(False), otherwise)
        for kind, r in rules:
            out = out.when((et == kind) if r.when is None else (et == kind) & r.when, value(r))
        return out.otherwise(otherwise)

    none = F.array().cast("array<string>")
    return j.select(
        "log_id", "run_id", "repo", "error_type",
        chain(lambda r: F.lit(r.success), F.lit(False)).alias("success"),
        F.when(et.isin(list(strategies)), et).otherwise(F.lit("none")).alias("action_type"),
        chain(lambda r: lit(r.details), F.concat(F.lit("No healing strategy for "), et)).alias("details"),
        chain(lambda r: F.array(*[lit(c) for c in r.changes]) if r.changes else none, none).alias("changes_made"),
        *extra,
    )


# ---------------------------------------------------------------------------------------------
# F9-F12 rewrites
# ---------------------------------------------------------------------------------------------

def rewrite_requirements(content: Column, package: Column) -> Column:
    """append the package line unless the text contains it anywhere."""
    cur = F.coalesce(content, F.lit(""))
    added = F.regexp_replace(F.concat(strip_ws(cur), F.lit("\n"), package, F.lit("\n")), java_regex(r"^\n+"), "")
    return F.when(cur.contains(package), cur).otherwise(added)


#: Packages that a strategy adds besides the missing one.
STRATEGY_PACKAGES = {"flaky_test": ["pytest-rerunfailures"], "network_timeout": ["requests", "urllib3"]}


def added_packages() -> Column:
    """the packages that a failure's strategy puts into the requirements, in order."""
    out = F.when((F.col("error_type") == "missing_dependency") & (F.coalesce("missing_package", F.lit("")) != ""), F.array("missing_package"))
    for kind, packages in STRATEGY_PACKAGES.items():
        out = out.when(F.col("error_type") == kind, F.array(*[F.lit(p) for p in packages]))
    return out.otherwise(F.array().cast("array<string>"))


def rewrite_pytest_timeout(content: Column) -> Column:
    """set every ``timeout = N`` to 300, or append a section; a missing file is created."""
    replaced = F.regexp_replace(content, java_regex(PYTEST_TIMEOUT_PATTERN), PYTEST_TIMEOUT_VALUE)
    return (F.when(content.isNull(), F.lit(PYTEST_TIMEOUT_NEW_FILE))
             .when(content.contains("timeout"), replaced)
             .otherwise(F.concat(content, F.lit(PYTEST_TIMEOUT_SECTION))))


def rewrite_pytest_reruns(content: Column) -> Column:
    """add the reruns option unless present; a missing file is created."""
    return (F.when(content.isNull(), F.lit(RERUNS_NEW_FILE))
             .when(content.contains("--reruns"), content)
             .otherwise(F.concat(content, F.lit(RERUNS_LINE))))


def rewrite_workflow_timeout(content: Column) -> Column:
    """set ``timeout-minutes`` to 60 where present; otherwise unchanged."""
    return F.when(content.contains("timeout-minutes"),
                  F.regexp_replace(content, java_regex(WORKFLOW_TIMEOUT_PATTERN), WORKFLOW_TIMEOUT_VALUE)) \
            .otherwise(content)


# ---------------------------------------------------------------------------------------------
# J11
# ---------------------------------------------------------------------------------------------

def requirement_lines(files: DataFrame) -> DataFrame:
    """Package names of every requirements.txt line (version spec and spaces removed)."""
    req = files.filter(F.col("path") == REQUIREMENTS)
    lines = req.select("repo", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    name = F.trim(F.regexp_replace("line", java_regex(r"[<>=!~;\[ ].*"), ""))
    return lines.select("repo", "line_no", name.alias("package")).filter(F.col("package") != "")


def vulnerable_dependency_fix(files: DataFrame, advisories: DataFrame) -> DataFrame:
    """Every required package with an advisory: the update to the safe version, or a
    failure when no safe version exists."""
    j = requirement_lines(files).join(advisories, "package", "inner")
    ok = F.col("safe_version").isNotNull()
    return j.select(
        "repo", "package", "safe_version", ok.alias("success"),
        F.when(ok, F.concat(F.lit("Updated "), F.col("package"), F.lit(" to "), F.col("safe_version")))
         .otherwise(F.lit("No safe version available")).alias("details"),
        F.when(ok, F.concat(F.col("package"), F.lit("=="), F.col("safe_version"))).alias("change"),
    )
