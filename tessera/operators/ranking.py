"""Features, weighted ranking, learned scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the deterministic ranker.
WEIGHTS = {
    "in_stack_trace": 45, "is_failing_test_target": 35, "in_compiler_error": 35, "in_dirty_diff": 25, "exact_symbol_match": 30, "exact_path_match": 25,
    "lexical": 2.0, "token_overlap": 15, "hop1": 20, "hop2": 10, "co_change": 15, "recent_change": 2,
    "semantic": 15, "implementation": 10, "edit_target": 25, "root_cause": 20, "lockfile": -30, "unrelated_test": -10,
}
#: Weights of the heuristic score of a feature row.
HEURISTIC = {"in_stack_trace": 40, "is_failing_test_target": 35, "in_compiler_error": 35, "in_dirty_diff": 25, "exact_symbol_match": 30, "exact_path_match": 25}


def c(name: str) -> Column:
    return F.col(name)


def total(columns: list[Column]) -> Column:
    out = columns[0]
    for x in columns[1:]:
        out = out + x
    return out


def near(hop1: float, hop2: float) -> Column:
    one = (c("min_distance_to_seed") == 1) | (c("min_distance_to_error_frame") == 1)
    two = (c("min_distance_to_seed") == 2) | (c("min_distance_to_error_frame") == 2)
    return F.when(one, hop1).when(two, hop2).otherwise(0.0)


def heuristic_score() -> Column:
    hop = lambda d: F.when(c(d) == 1, 20.0).when(c(d) == 2, 10.0).otherwise(0.0)
    return total([F.when(c(k), float(w)).otherwise(0.0) for k, w in HEURISTIC.items()]) + F.least(F.lit(25.0), c("lexical_score")) + c("token_overlap_ratio") * 15 + hop("min_distance_to_seed") + hop("min_distance_to_error_frame") + c("max_co_change") * 15 + F.least(F.lit(10.0), c("recent_changes") * 2.0)


#: The vector's order; the first 28 without judgments.
BOOLEANS = {1: "is_test", 2: "is_config", 3: "is_documentation", 4: "is_schema", 5: "is_exported", 6: "exact_symbol_match", 7: "exact_path_match", 13: "is_direct_dependency", 14: "is_direct_dependent", 18: "in_stack_trace", 19: "is_failing_test_target", 20: "in_compiler_error", 21: "in_dirty_diff", 22: "from_exact", 23: "from_lexical", 24: "from_graph", 25: "from_history", 26: "from_runtime"}
SCALED = {0: ("tokens", 2000), 8: ("lexical_score", 25), 10: ("graph_degree", 20), 15: ("changes", 50), 16: ("recent_changes", 10), 27: ("heuristic_score", 100)}
PLAIN = {9: "token_overlap_ratio", 17: "max_co_change"}
DISTANCES = {11: "min_distance_to_seed", 12: "min_distance_to_error_frame"}
JUDGMENTS = ["semantic", "implementation", "edit_target", "root_cause"]


def feature_vector(judged: bool = True) -> Column:
    at: dict[int, Column] = {i: F.when(c(k), 1.0).otherwise(0.0) for i, k in BOOLEANS.items()}
    at |= {i: F.least(F.lit(1.0), c(k) / n) for i, (k, n) in SCALED.items()}
    at |= {i: c(k).cast("double") for i, k in PLAIN.items()}
    at |= {i: F.when(c(k).isNull(), -1.0).when(c(k) == 1, 1.0).when(c(k) == 2, 0.5).otherwise(0.2) for i, k in DISTANCES.items()}
    values = [at[i] for i in range(28)]
    if judged:
        values += [F.when(c("has_judgment"), 1.0).otherwise(0.0), *[F.coalesce(c(j), F.lit(0.0)) for j in JUDGMENTS]]
    return F.array(*values)


def rank_score() -> tuple[Column, Column]:
    """The weighted score (2 places) and the names of the reasons for it."""
    w = WEIGHTS
    flags = ["in_stack_trace", "is_failing_test_target", "in_compiler_error", "in_dirty_diff", "exact_symbol_match", "exact_path_match"]
    lexical = F.least(F.lit(20.0), c("lexical_score") * w["lexical"])
    recent = F.least(F.lit(10.0), c("recent_changes") * float(w["recent_change"]))
    boost = total([F.when(c(j) > 0, float(w[j]) * c(j) * F.coalesce("confidence", F.lit(1.0))).otherwise(0.0) for j in JUDGMENTS])
    lock = (c("kind") == "LOCKFILE") & ~c("exact_path_match")
    stray = c("is_test") & ~c("is_failing_test_target") & ~c("exact_path_match") & ~c("exact_symbol_match")
    score = total([F.when(c(k), float(w[k])).otherwise(0.0) for k in flags]) + lexical + c("token_overlap_ratio") * w["token_overlap"] + near(float(w["hop1"]), float(w["hop2"])) + c("max_co_change") * w["co_change"] + recent + boost
    score = score + F.when(lock, float(w["lockfile"])).otherwise(0.0) + F.when(stray, float(w["unrelated_test"])).otherwise(0.0)
    said = F.array_compact(F.array(*[F.when(c(j) > 0, j) for j in JUDGMENTS], *[F.when(c(k), k) for k in flags], F.when(lexical > 0, "lexical"), F.when(near(1.0, 0.0) == 1, "hop1").when(near(0.0, 1.0) == 1, "hop2"), F.when(c("max_co_change") > 0, "co_change"), F.when(lock, "lockfile"), F.when(stray, "unrelated_test")))
    return F.round(score, 2), said


def ranked(df: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(c(score).desc(), c(tie))))


#: Features that each ablation masks.
MASKS = {"full": [], "no_judgment": JUDGMENTS, "no_graph": ["min_distance_to_seed", "min_distance_to_error_frame", "graph_degree"], "no_history": ["changes", "recent_changes", "max_co_change"], "no_runtime": ["in_stack_trace", "is_failing_test_target", "in_compiler_error"]}


def masked(df: DataFrame, variant: str) -> DataFrame:
    """df with a variant's features at their missing value: null for distances and judgments, false for flags, 0 for numbers."""
    types = dict(df.dtypes)
    blank = lambda k: F.lit(None).cast(types[k]) if k.startswith("min_") or k in JUDGMENTS else F.lit(False) if types[k] == "boolean" else F.lit(0).cast(types[k])
    return df.withColumns({k: blank(k) for k in MASKS[variant]}) if MASKS[variant] else df


def stump_score(vector: Column, stumps: list[tuple[int, float, float, float]], rate: float, base: float = 0.0) -> Column:
    """Boosted stumps (feature, threshold, at most, above) as one column expression."""
    return F.lit(base) + rate * total([F.lit(0.0), *[F.when(F.get(vector, F.lit(f)) <= t, a).otherwise(b) for f, t, a, b in stumps]])


def linear_score(vector: Column, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(vector, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def safe_score(learned: Column, fallback: Column, key: Column) -> Column:
    """The learned score, or for all of a task's rows the fallback if one of them is missing or not finite."""
    bad = learned.isNull() | F.isnan(learned) | (F.abs(learned) == float("inf"))
    return F.when(F.bool_or(bad).over(Window.partitionBy(key)), fallback).otherwise(learned)


def shadow_candidates(df: DataFrame, top: int = 12, diverse: int = 8, most: int = 20) -> DataFrame:
    """The first `top` ranks, up to `diverse` diverse ones after them, then the next ranks up to `most`. df: task_id, unit_id, rank, is_diverse."""
    by_task = Window.partitionBy("task_id")
    nth = F.row_number().over(by_task.orderBy(~((c("rank") > top) & c("is_diverse")), "rank"))
    level = F.when(c("rank") <= top, 0).when(c("is_diverse") & (nth <= diverse), 1).otherwise(2)
    rows = df.withColumn("level", level).withColumn("place", F.row_number().over(by_task.orderBy("level", "rank")))
    return rows.filter(c("place") <= most)
