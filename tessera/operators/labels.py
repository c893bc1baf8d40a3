"""Labels and outcomes. Unknown is never negative: tri-state columns stay null where nothing is known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL = ["FULL_TOOL_TRACE", "HARNESS_NATIVE"]
LIMITED = ["OWN_CALLS_ONLY", "PARTIAL_AGENT_TRACE"]


def c(name: str) -> Column:
    return F.col(name)


def observation_label(exposed: Column, inspected: Column, edited: Column, in_trace: Column) -> Column:
    return F.when(edited | inspected | in_trace, "POSITIVE").when(exposed, "NEGATIVE").otherwise("UNEXPOSED_UNKNOWN")


#: Kinds of positive evidence: confidence and strength of each.
EVIDENCE = {"EDITED": (0.95, "STRONG"), "READ": (0.85, "MEDIUM"), "REQUESTED": (0.9, "STRONG"), "FAILURE_TRACE": (0.8, "MEDIUM"), "TEST_RELATED": (0.75, "MEDIUM")}


def label_evidence(behaviour: dict[str, Column]) -> Column:
    """Array of (label_type, confidence, strength) of the kinds of evidence that hold."""
    return F.array_compact(F.array(*[F.when(behaviour[k], F.struct(F.lit(k).alias("label_type"), F.lit(p).alias("confidence"), F.lit(s).alias("strength"))) for k, (p, s) in EVIDENCE.items() if k in behaviour]))


def resolved_label(evidence: Column, exposed: Column, observability: Column, succeeded: Column) -> Column:
    return (
        F.when(F.size(evidence) > 0, "POSITIVE")
        .when(~exposed, "UNEXPOSED_UNKNOWN")
        .when(observability.isin(LIMITED), "UNKNOWN")
        .when(succeeded.eqNullSafe(F.lit(True)), "WEAK_NEGATIVE")
        .otherwise("UNKNOWN")
    )


def dataset_label(is_target: Column, exposed: Column, observability: Column, read: Column, edited: Column, succeeded: Column) -> Column:
    """Struct of label_state and confidence."""
    ok = succeeded.eqNullSafe(F.lit(True))
    state = lambda s, p: F.struct(F.lit(s).alias("label_state"), F.lit(p).alias("confidence"))
    return (
        F.when(is_target, state("POSITIVE", 0.98))
        .when(edited.eqNullSafe(F.lit(True)) & ok, state("POSITIVE", 0.95))
        .when(read.eqNullSafe(F.lit(True)) & ok, state("POSITIVE", 0.85))
        .when(exposed & observability.isin(FULL) & ok & read.eqNullSafe(F.lit(False)) & edited.eqNullSafe(F.lit(False)), state("WEAK_NEGATIVE", 0.7))
        .otherwise(state("UNKNOWN", 0.5))
    )


def read_default(exposed: Column, observability: Column) -> Column:
    return F.when(exposed & ~observability.isin(LIMITED), F.lit(False))


def edit_default(exposed: Column, observability: Column) -> Column:
    return F.when(F.when(exposed, ~observability.isin(LIMITED)).otherwise(observability.isin(FULL)), F.lit(False))


def binary_label(edited: Column, read: Column, succeeded: Column, exposed: Column, observability: Column) -> Column:
    """Struct of outcome_label and label (1, 0 or null)."""
    out = lambda s, v: F.struct(F.lit(s).alias("outcome_label"), F.lit(v).cast("int").alias("label"))
    ok, yes = succeeded.eqNullSafe(F.lit(True)), F.lit(True)
    return (
        F.when(edited.eqNullSafe(yes) | (ok & read.eqNullSafe(yes)), out("POSITIVE", 1))
        .when(~exposed, out("UNEXPOSED_UNKNOWN", None))
        .when(observability.isin(LIMITED) | read.isNull(), out("UNKNOWN", None))
        .when(ok, out("WEAK_NEGATIVE", 0))
        .otherwise(out("UNKNOWN", None))
    )


def relevance_grade(edited: Column, read: Column, succeeded: Column, exposed: Column, observability: Column) -> Column:
    ok, yes = succeeded.eqNullSafe(F.lit(True)), F.lit(True)
    return (
        F.when(edited.eqNullSafe(yes) & ok, 4)
        .when(edited.eqNullSafe(yes), 3)
        .when(read.eqNullSafe(yes) & ok, 2)
        .when(read.eqNullSafe(yes), 1)
        .when(~exposed | observability.isin(LIMITED) | read.isNull(), F.lit(None).cast("int"))
        .when(ok, 0)
    )


#: The exposure ladder, lowest first.
LADDER = ["CANDIDATE", "SELECTED", "MATERIALIZED", "SHOWN", "READ", "EDITED"]


def exposure_state(flags: dict[str, Column]) -> Column:
    out = F.lit(LADDER[0])
    for step in LADDER[1:]:
        out = F.when(F.coalesce(flags[step], F.lit(False)), step).otherwise(out)
    return out


def evidence_outcome() -> Column:
    """Struct of verified_success (tri-state) and confidence from the columns of outcome evidence; the first rule that holds counts."""
    out = lambda v, p: F.struct(F.lit(v).cast("boolean").alias("verified_success"), F.lit(p).alias("confidence"))
    sound = ~c("regression_tests").eqNullSafe(F.lit(False)) & ~c("security_checks").eqNullSafe(F.lit(False))
    is_ = lambda name, v: c(name).eqNullSafe(F.lit(v))
    rules = [
        (c("human_review").eqNullSafe(F.lit("PASS")), out(True, 1.0)),
        (c("human_review").eqNullSafe(F.lit("FAIL")), out(False, 1.0)),
        (is_("hidden_tests", True) & sound, out(True, 0.98)),
        (is_("behavioral_oracle", True) & sound, out(True, 0.95)),
        (is_("hidden_tests", False), out(False, 0.98)),
        (is_("behavioral_oracle", False), out(False, 0.98)),
        (is_("regression_tests", False), out(None, 0.5)),
        (is_("build", False), out(None, 0.4)),
        (is_("public_tests", False), out(None, 0.5)),
        (is_("public_tests", True), out(None, 0.6)),
        (is_("build", True), out(None, 0.4)),
        (c("user_accepted").isNotNull(), out(None, 0.5)),
        (c("agent_reported").isNotNull(), out(None, 0.35)),
    ]
    result = out(None, 0.1)
    for test, value in reversed(rules):
        result = F.when(test, value).otherwise(result)
    return result


def task_outcome() -> Column:
    """Struct of verified_success and confidence (a word) from the columns of a task's checks."""
    out = lambda v, p: F.struct(F.lit(v).cast("boolean").alias("verified_success"), F.lit(p).alias("confidence"))
    is_ = lambda name, v: c(name).eqNullSafe(F.lit(v))
    rules = [
        (c("human_review").eqNullSafe(F.lit("PASS")), out(True, "HIGH")),
        (c("human_review").eqNullSafe(F.lit("FAIL")), out(False, "HIGH")),
        (is_("task_verifier", True) & is_("regression_tests", False), out(False, "HIGH")),
        (is_("task_verifier", True), out(True, "HIGH")),
        (is_("task_verifier", False), out(False, "HIGH")),
        (is_("build", False) | is_("typecheck", False), out(False, "HIGH")),
        (is_("targeted_tests", True) & is_("regression_tests", False), out(False, "HIGH")),
        (is_("targeted_tests", True), out(True, "MEDIUM")),
        (is_("targeted_tests", False), out(False, "MEDIUM")),
    ]
    result = out(None, "UNKNOWN")
    for test, value in reversed(rules):
        result = F.when(test, value).otherwise(result)
    return result


def confidence_bucket(p: Column) -> Column:
    return F.when(p >= 0.9, "HIGH").when(p >= 0.7, "MEDIUM").when(p > 0.3, "LOW").otherwise("UNKNOWN")
