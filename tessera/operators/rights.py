"""Rights: permissions, multi-reason filters, redaction, revocation, lineage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import has_secret, redact_secrets


def conjunctive(df: DataFrame, equal: dict[str, object] | None = None) -> DataFrame:
    """Rows that equal every given value; None asks for null."""
    tests = [F.col(k).isNull() if v is None else F.col(k) == F.lit(v) for k, v in (equal or {}).items()]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def reasons(rules: dict[str, Column]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))


def first_reason(rules: dict[str, Column]) -> Column:
    """The name of the first rule that holds, or null."""
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in rules.items()])


def permitted(subjects: DataFrame, rights: DataFrame, legacy: Column) -> DataFrame:
    """subjects with `allowed`: an explicit right for (subject, data_class, operation) comes before the legacy flag."""
    return subjects.join(rights, ["subject", "data_class", "operation"], "left").withColumn("allowed", F.coalesce("explicit", legacy)).drop("explicit")


def provenance_rules(cutoff: str, require_verified: bool = True) -> dict[str, Column]:
    """First failing reason of a source's provenance (columns permission, verified, cutoff_date); a missing one fails."""
    p = F.col("permission")
    rules = {
        "MISSING_PROVENANCE": p.isNull(),
        "TRAINING_PERMISSION_REVIEW": p == "REVIEW",
        "TRAINING_PERMISSION_FORBIDDEN": p == "FORBIDDEN",
        "TRAINING_PERMISSION_INVALID": p != "ALLOWED",
        "UNVERIFIED_PROVENANCE": F.lit(require_verified) & ~F.coalesce("verified", F.lit(False)),
        "CUTOFF_EXCEEDED": F.col("cutoff_date") > F.lit(cutoff).cast("timestamp"),
    }
    return rules


def observation_rules(expiry: Column, allow_weak: bool = True) -> dict[str, Column]:
    """All failing reasons of an observation: columns training_allowed, operation_allowed, class_allowed, provenance, outcome_label, has_features."""
    allowed = F.coalesce("training_allowed", F.lit(False))
    label = F.col("outcome_label")
    return {
        "TRAINING_NOT_ALLOWED": ~allowed,
        "TRAINING_OPERATION_FORBIDDEN": allowed & ~F.coalesce("operation_allowed", F.lit(True)),
        "DATA_CLASS_FORBIDDEN": ~F.coalesce("class_allowed", F.lit(False)),
        "PROVENANCE_INELIGIBLE": F.col("provenance").isNotNull() & (F.col("provenance") != "OK"),
        "RETENTION_EXPIRED": expiry,
        "INVALID_LABEL_UNEXPOSED": label == "UNEXPOSED_UNKNOWN",
        "INVALID_LABEL_UNKNOWN": label == "UNKNOWN",
        "CONFIG_EXCLUDED_WEAK_NEGATIVE": (label == "WEAK_NEGATIVE") & F.lit(not allow_weak),
        "MISSING_FEATURES": ~F.coalesce("has_features", F.lit(False)),
    }


def redacted(column: str, allowed: Column) -> Column:
    """A text column, or a mark where it may not be kept."""
    return F.when(allowed, F.col(column)).otherwise(F.lit(f"[REDACTED_{column.upper()}]"))


def egress(remote: Column, trusted: Column, classes: Column, content: Column, block: bool) -> Column:
    """Struct of allowed, reason (the first failing one) and the content that may go."""
    reason = first_reason({"REMOTE_DISALLOWED": ~remote, "UNTRUSTED": ~trusted, "CLASS_FORBIDDEN": ~classes, "SECRET_FOUND": has_secret(content) & F.lit(block)})
    return F.struct(reason.isNull().alias("allowed"), reason.alias("reason"), F.when(reason.isNull(), redact_secrets(content)).alias("content"))


#: Commands that may run in the sandbox, and parts that forbid a command line.
ALLOWED_COMMANDS = ["git", "node", "scip", "tree-sitter"]
DENIED_PARTS = ["npm install", "pip install", "curl ", "wget ", "sh ", "bash ", ".sh"]


def command_allowed(line: Column) -> Column:
    line = F.regexp_replace(line, r"^\s+|\s+$", "")
    denied = reduce(lambda a, b: a | b, [F.contains(line, F.lit(p)) for p in DENIED_PARTS])
    return F.when(line == "", False).when(denied, False).otherwise(F.split(line, r"\s+")[0].isin(ALLOWED_COMMANDS))


def not_revoked(df: DataFrame, revocations: DataFrame, key: str) -> DataFrame:
    return df.join(revocations, key, "left_anti")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose key is blank, unknown or without a parent."""
    hit = parents.select(F.col(key), F.lit(True).alias("_hit")).distinct()
    blank = F.col(key).isNull() | F.col(key).cast("string").isin("", "unknown")
    return children.join(hit, key, "left").filter(blank | F.col("_hit").isNull()).drop("_hit")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def resolve_lineage(outcomes: DataFrame, plans: DataFrame) -> DataFrame:
    """code and plan of each outcome (outcome_id, task_id, plan_id): by plan id if it is of the task, else the task's only plan."""
    own = plans.select(F.col("plan_id"), F.col("task_id").alias("plan_task"))
    per_task = plans.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.min("plan_id").alias("only"))
    rows = outcomes.join(own, "plan_id", "left").join(per_task, "task_id", "left")
    code = (
        F.when(F.col("plan_id").isNotNull() & F.col("plan_task").isNull(), "PLAN_NOT_FOUND")
        .when(F.col("plan_task").isNotNull() & (F.col("plan_task") != F.col("task_id")), "TASK_MISMATCH")
        .when(F.col("plan_id").isNotNull(), "RESOLVED")
        .when(F.coalesce("n", F.lit(0)) == 0, "NO_PLAN")
        .when(F.col("n") > 1, "AMBIGUOUS")
        .otherwise("RESOLVED_BY_TASK")
    )
    plan = F.when(code == "RESOLVED", F.col("plan_id")).when(code == "RESOLVED_BY_TASK", F.col("only"))
    return rows.select("outcome_id", code.alias("code"), plan.alias("resolved_plan"))


def purge_trace(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows to delete: those that share a source observation with a request (arrays), or its repository or task. requests, rows: sources, repository, task."""
    by_source = rows.select("row_id", F.explode("sources").alias("s")).join(requests.select("request_id", F.explode("sources").alias("s")), "s").select("request_id", "row_id")
    by_repository = rows.join(requests.filter("repository is not null").select("request_id", "repository"), "repository").select("request_id", "row_id")
    by_task = rows.join(requests.filter("task is not null").select("request_id", "task"), "task").select("request_id", "row_id")
    return by_source.union(by_repository).union(by_task).distinct()


#: Fields that may not be known before an outcome, and the set of features that a snapshot must name.
FORBIDDEN_BEFORE_OUTCOME = ["solutionCommit", "solutionDiff", "futurePatch", "futureChangedFiles", "futureTests", "postTaskReads", "postTaskEdits", "agentEdits", "agentTrajectory", "verifiedSuccess", "verifiedOutcome", "humanReview"]
FEATURE_SET = "CONTEXT_FEATURES_V1"


def integrity_audit(snapshots: DataFrame) -> DataFrame:
    """episode_id, has_leakage, has_hash_mismatch, has_provenance_error, passed of sealed snapshots, taken before the outcome was known.

    snapshots: episode_id, fields (a map of all of a snapshot's fields to their JSON), candidate_fields (the names of the fields of its
    candidates and their features), body (canonical JSON without the seal), seal, base_commit, cutoff_commit, feature_set. A null
    body stands for a snapshot that can't be read.
    """
    forbidden = F.array(*map(F.lit, FORBIDDEN_BEFORE_OUTCOME))
    own = F.map_keys(F.map_filter("fields", lambda _, v: v.isNotNull()))
    leak = F.coalesce(F.arrays_overlap(own, forbidden), F.lit(False)) | F.coalesce(F.arrays_overlap("candidate_fields", forbidden), F.lit(False))
    commit = F.coalesce("base_commit", F.lit(""))
    origin = ((F.length(commit) != 40) & (commit != "HEAD")) | (F.coalesce("cutoff_commit", F.lit("")) == "") | ~F.col("feature_set").eqNullSafe(F.lit(FEATURE_SET))
    corrupt = F.col("body").isNull()
    rows = snapshots.select("episode_id", (leak & ~corrupt).alias("has_leakage"), (corrupt | ~F.sha2("body", 256).eqNullSafe(F.col("seal"))).alias("has_hash_mismatch"), (corrupt | origin).alias("has_provenance_error"))
    return rows.withColumn("passed", ~F.col("has_leakage") & ~F.col("has_hash_mismatch") & ~F.col("has_provenance_error"))


def acceptance(minimum_valid: int = 1, least_share: float | None = None, production: bool = True) -> Column:
    """Names of the criteria of a live run that fail, in order; none means that it is accepted. A measure that is null doesn't count
    against the run, where its criterion is only about what was measured.

    Columns: live, endpoint_production, provenance_clean, harness_error, selected, started, completed, attempts, successes, valid_signals,
    failed_calls, fallback_only, synthetic, http_requests, max_http_requests, task_attempts_exceeded, requests_exceeded, plan_invariant,
    lineage_verified, lineage_complete, no_lineage_mismatch, no_unexpected_egress, report_consistent.
    """
    c, zero = F.col, F.lit(0)
    no = lambda x: c(x).eqNullSafe(F.lit(False))
    missing = lambda x: ~F.coalesce(c(x), F.lit(False))
    known = lambda test: F.coalesce(test, F.lit(False))
    attempts, successes = F.coalesce("attempts", zero), F.coalesce("successes", zero)
    tests = {
        "live": no("live"), "production endpoint": no("endpoint_production") & F.lit(production), "clean provenance": no("provenance_clean"), "harness without error": c("harness_error").isNotNull(),
        "all selected started": known(c("started") != c("selected")), "all selected completed": known(c("completed") != c("selected")),
        "provider attempts": attempts <= 0, "provider successes": successes < minimum_valid, "valid signals": F.coalesce("valid_signals", zero) < minimum_valid,
        "no failed calls": ~c("failed_calls").eqNullSafe(zero), "no fallback only": known(c("fallback_only") > 0), "no synthetic signals": known(c("synthetic") > 0),
        "requests within budget": known(c("http_requests") > c("max_http_requests")), "attempts per task": c("task_attempts_exceeded").eqNullSafe(F.lit(True)), "request budget kept": c("requests_exceeded").eqNullSafe(F.lit(True)),
        "plans invariant": missing("plan_invariant"), "lineage verified": no("lineage_verified"), "lineage complete": no("lineage_complete"), "no lineage mismatch": missing("no_lineage_mismatch"),
        "no unexpected egress": missing("no_unexpected_egress"), "report consistent": no("report_consistent"),
    }
    if least_share is not None:
        tests["share of successes"] = (attempts > 0) & (successes / F.greatest(attempts, F.lit(1)) < least_share)
    return F.array_compact(F.array(*[F.when(t, name) for name, t in tests.items()]))
