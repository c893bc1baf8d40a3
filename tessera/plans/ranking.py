"""Queries of features, ranking and scorers; order lines stand for candidates, with flags from their keys."""

from pyspark.sql import functions as F

from tessera.operators.ranking import JUDGMENTS, MASKS, WEIGHTS, feature_vector, heuristic_score, linear_score, masked, rank_score, ranked, safe_score, shadow_candidates, stump_score
from tessera.operators.judgments import ProviderFailure, local_judgment, shadow_run
from tessera.plans.retrieval import _FLOW, fused_candidates
from tessera.registry import query
from tessera.sources.tables import TASKS, UNITS, table, tasks, units


def c(name):
    return F.col(name)


#: Features from the keys of an order line: name -> SQL that both engines read alike.
_FEATURES = {
    "tokens": "CAST(l_quantity AS BIGINT) * 60", "kind": "CASE l_partkey % 6 WHEN 0 THEN 'LOCKFILE' WHEN 1 THEN 'TEST' WHEN 2 THEN 'CONFIG' ELSE 'SOURCE_FILE' END",
    "is_test": "l_partkey % 6 = 1", "is_config": "l_partkey % 6 = 2", "is_documentation": "l_partkey % 10 = 3", "is_schema": "l_partkey % 10 = 4", "is_exported": "l_partkey % 2 = 0",
    "exact_symbol_match": "l_partkey % 13 = 0", "exact_path_match": "l_partkey % 17 = 0", "lexical_score": "CAST((l_partkey * 7 % 300) AS DOUBLE) / 10", "token_overlap_ratio": "CAST((l_suppkey % 11) AS DOUBLE) / 10",
    "graph_degree": "CAST(l_partkey % 31 AS INT)", "min_distance_to_seed": "CASE WHEN l_partkey % 5 < 4 THEN CAST(l_partkey % 5 AS INT) END", "min_distance_to_error_frame": "CASE WHEN l_suppkey % 7 < 3 THEN CAST(l_suppkey % 7 AS INT) END",
    "is_direct_dependency": "l_partkey % 5 = 1", "is_direct_dependent": "l_partkey % 10 = 1", "changes": "CAST(l_partkey % 70 AS INT)", "recent_changes": "CAST(l_partkey % 8 AS INT)", "max_co_change": "CAST((l_partkey % 9) AS DOUBLE) / 10",
    "in_stack_trace": "l_partkey % 19 = 0", "is_failing_test_target": "l_partkey % 23 = 0", "in_compiler_error": "l_partkey % 29 = 0", "in_dirty_diff": "l_partkey % 31 = 0",
    "from_exact": "l_partkey % 13 = 0", "from_lexical": "l_partkey % 2 = 1", "from_graph": "l_partkey % 5 < 3", "from_history": "l_partkey % 9 > 4", "from_runtime": "l_partkey % 19 = 0",
    "has_judgment": "l_partkey % 4 = 0", "semantic": "CASE WHEN l_partkey % 4 = 0 THEN CAST((l_partkey % 11) AS DOUBLE) / 10 END", "implementation": "CASE WHEN l_partkey % 4 = 0 THEN CAST((l_partkey % 7) AS DOUBLE) / 10 END",
    "edit_target": "CASE WHEN l_partkey % 4 = 0 THEN CAST((l_partkey % 3) AS DOUBLE) / 10 END", "root_cause": "CASE WHEN l_partkey % 8 = 0 THEN CAST((l_partkey % 9) AS DOUBLE) / 10 END", "confidence": "CASE WHEN l_partkey % 16 = 0 THEN 0.5::DOUBLE END",
}
_NEAR = "CASE WHEN {0} = 1 THEN 20 WHEN {0} = 2 THEN 10 ELSE 0 END"
_H = f"""(CASE WHEN in_stack_trace THEN 40 ELSE 0 END + CASE WHEN is_failing_test_target THEN 35 ELSE 0 END + CASE WHEN in_compiler_error THEN 35 ELSE 0 END + CASE WHEN in_dirty_diff THEN 25 ELSE 0 END
  + CASE WHEN exact_symbol_match THEN 30 ELSE 0 END + CASE WHEN exact_path_match THEN 25 ELSE 0 END + least(25, lexical_score) + token_overlap_ratio * 15 + {_NEAR.format('min_distance_to_seed')} + {_NEAR.format('min_distance_to_error_frame')}
  + max_co_change * 15 + least(10, recent_changes * 2))"""
_BASE = "(SELECT DISTINCT l_orderkey AS task_id, l_partkey AS unit_id, " + ", ".join(f"{v} AS {k}" for k, v in _FEATURES.items()) + " FROM lineitem)"
FEATURES = f"(SELECT *, {_H} AS heuristic_score FROM {_BASE})"


#: The features that don't follow from the unit alone.
OWN = {k: v for k, v in _FEATURES.items() if "l_partkey" not in v}


def with_unit_features(rows):
    """rows (unit_id and the features of OWN) with the features that follow from these, which need not be shuffled."""
    rows = rows.withColumns({k: F.expr(v.replace("l_partkey", "unit_id").replace("::DOUBLE", "D")) for k, v in _FEATURES.items() if k not in OWN})
    return rows.withColumn("heuristic_score", heuristic_score())


def features(spark, folder):
    lines = table(spark, folder, "lineitem").selectExpr("l_orderkey AS task_id", "l_partkey AS unit_id", *[f"{v} AS {k}" for k, v in OWN.items()]).distinct()
    return with_unit_features(lines).select("task_id", "unit_id", *_FEATURES, "heuristic_score")


def least_vector():
    """Of one unit's rows, the features of OWN whose vector is the least: within a unit, vectors differ in these places alone."""
    places = [F.get(feature_vector(), F.lit(i)).alias(f"at{i}") for i in (0, 9, 12, 27)]
    return F.min(F.struct(*places, F.struct(*OWN).alias("own")))["own"]


@query(f"SELECT task_id, unit_id, round(heuristic_score, 4) AS heuristic_score, min_distance_to_seed, graph_degree, in_stack_trace FROM {FEATURES}")
def r07_features(spark, folder):
    return features(spark, folder).select("task_id", "unit_id", F.round("heuristic_score", 4).alias("heuristic_score"), "min_distance_to_seed", "graph_degree", "in_stack_trace")


_DIST = "CASE WHEN {0} IS NULL THEN -1 WHEN {0} = 1 THEN 1 WHEN {0} = 2 THEN 0.5 ELSE 0.2 END"
_VECTOR = ["least(1, tokens / 2000)", *[f"CASE WHEN {k} THEN 1 ELSE 0 END" for k in ("is_test", "is_config", "is_documentation", "is_schema", "is_exported", "exact_symbol_match", "exact_path_match")], "least(1, lexical_score / 25)", "token_overlap_ratio", "least(1, graph_degree / 20)",
    _DIST.format("min_distance_to_seed"), _DIST.format("min_distance_to_error_frame"), "CASE WHEN is_direct_dependency THEN 1 ELSE 0 END", "CASE WHEN is_direct_dependent THEN 1 ELSE 0 END", "least(1, changes / 50)", "least(1, recent_changes / 10)", "max_co_change",
    *[f"CASE WHEN {k} THEN 1 ELSE 0 END" for k in ("in_stack_trace", "is_failing_test_target", "in_compiler_error", "in_dirty_diff", "from_exact", "from_lexical", "from_graph", "from_history", "from_runtime")], "least(1, heuristic_score / 100)", "CASE WHEN has_judgment THEN 1 ELSE 0 END", *[f"coalesce({j}, 0)" for j in JUDGMENTS]]
_SUM = " + ".join(f"{i + 1} * ({v})" for i, v in enumerate(_VECTOR))


@query(f"SELECT task_id, unit_id, {len(_VECTOR)} AS width, round({_SUM}, 4)::DOUBLE AS weighted FROM {FEATURES}")
def r08_feature_vector(spark, folder):
    rows = features(spark, folder).withColumn("v", feature_vector())
    weighted = F.aggregate(F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return rows.select("task_id", "unit_id", F.size("v").alias("width"), F.round(weighted, 4).alias("weighted"))


def _flag(test, weight):
    return f"CASE WHEN {test} THEN {weight} ELSE 0 END"


_FLAGS = ["in_stack_trace", "is_failing_test_target", "in_compiler_error", "in_dirty_diff", "exact_symbol_match", "exact_path_match"]
_STRAY = "is_test AND NOT is_failing_test_target AND NOT exact_path_match AND NOT exact_symbol_match"
_LOCK = "kind = 'LOCKFILE' AND NOT exact_path_match"
_ONE, _TWO = ("coalesce(min_distance_to_seed = {0}, false) OR coalesce(min_distance_to_error_frame = {0}, false)".format(k) for k in (1, 2))
_RANK_SCORE = " + ".join([*[_flag(k, WEIGHTS[k]) for k in _FLAGS], "least(20, lexical_score * 2)", "token_overlap_ratio * 15", f"CASE WHEN {_ONE} THEN 20 WHEN {_TWO} THEN 10 ELSE 0 END", "max_co_change * 15", "least(10, recent_changes * 2)",
    *[f"CASE WHEN {j} > 0 THEN {WEIGHTS[j]} * {j} * coalesce(confidence, 1) ELSE 0 END" for j in JUDGMENTS], _flag(_LOCK, -30), _flag(_STRAY, -10)])


@query(f"SELECT task_id, unit_id, round({_RANK_SCORE}, 2) AS score FROM {FEATURES}")
def r09_rank_scores(spark, folder):
    return features(spark, folder).select("task_id", "unit_id", rank_score()[0].alias("score"))


_SAID = "list_filter([" + ", ".join([*[f"CASE WHEN {j} > 0 THEN '{j}' END" for j in JUDGMENTS], *[f"CASE WHEN {k} THEN '{k}' END" for k in _FLAGS], "CASE WHEN lexical_score > 0 THEN 'lexical' END", f"CASE WHEN {_ONE} THEN 'hop1' WHEN {_TWO} THEN 'hop2' END", "CASE WHEN max_co_change > 0 THEN 'co_change' END", f"CASE WHEN {_LOCK} THEN 'lockfile' END", f"CASE WHEN {_STRAY} THEN 'unrelated_test' END"]) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT task_id, unit_id, array_to_string({_SAID}, ',') AS reasons FROM {FEATURES}")
def r09_rank_reasons(spark, folder):
    return features(spark, folder).select("task_id", "unit_id", F.array_join(rank_score()[1], ",").alias("reasons"))


_RANKED = f"(SELECT task_id, unit_id, score, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, unit_id) AS rank FROM (SELECT task_id, unit_id, round({_RANK_SCORE}, 2) AS score FROM {FEATURES}))"


@query(f"SELECT * FROM {_RANKED}")
def w01_rank(spark, folder):
    return ranked(r09_rank_scores(spark, folder), "task_id", "score", "unit_id")


_BLANK = {k: "NULL" if k.startswith("min_") or k in JUDGMENTS else "false" if k in _FLAGS else "0" for v in MASKS.values() for k in v}


def _masked_sql(variant):
    return "(SELECT * REPLACE (" + ", ".join(f"{_BLANK[k]} AS {k}" for k in MASKS[variant]) + f") FROM {FEATURES})" if MASKS[variant] else FEATURES


@query(" UNION ALL ".join(f"SELECT '{v}' AS variant, count(*) AS n, round(sum(round({_RANK_SCORE}, 2)), 2)::DOUBLE AS total_score FROM {_masked_sql(v)}" for v in MASKS))
def p18_feature_masking(spark, folder):
    f, out = features(spark, folder), None
    for variant in MASKS:
        rows = masked(f, variant).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(rank_score()[0]), 2).alias("total_score")).select(F.lit(variant).alias("variant"), "n", "total_score")
        out = rows if out is None else out.unionAll(rows)
    return out


#: A small boosted model and a linear one, as trained ones would be given: feature, threshold, value at most, value above.
STUMPS = [(0, 0.5, 0.25, -0.25), (8, 0.4, -0.5, 0.5), (11, 0.3, -0.125, 0.125), (18, 0.5, -0.75, 0.75), (27, 0.3, -1.0, 1.0)]
LINEAR = [((i * 7) % 11 - 5) / 7 for i in range(33)]


def _stumps_sql():
    return "0.08 * (" + " + ".join(f"CASE WHEN ({_VECTOR[f]}) <= {t} THEN {a} ELSE {b} END" for f, t, a, b in STUMPS) + ")"


@query(f"SELECT task_id, unit_id, round(({_stumps_sql()}) * 10 + heuristic_score * 0.1, 3)::DOUBLE AS score FROM {FEATURES}")
def m02_boosted_score(spark, folder):
    rows = features(spark, folder).withColumn("v", feature_vector())
    return rows.select("task_id", "unit_id", F.round(stump_score(c("v"), STUMPS, 0.08) * 10 + c("heuristic_score") * 0.1, 3).alias("score"))


_DOT = " + ".join(f"({w}) * ({v})" for w, v in zip(LINEAR, _VECTOR, strict=True))


@query(f"SELECT task_id, unit_id, round({_DOT}, 4)::DOUBLE AS score FROM {FEATURES}")
def m04_linear_score(spark, folder):
    rows = features(spark, folder).withColumn("v", feature_vector())
    return rows.select("task_id", "unit_id", F.round(linear_score(c("v"), LINEAR), 4).alias("score"))


@query(f"SELECT task_id, unit_id, CASE WHEN bool_or(unit_id % 40 = 0) OVER (PARTITION BY task_id) THEN round(heuristic_score, 3) ELSE CAST(tokens AS DOUBLE) END AS score FROM {FEATURES}")
def m05_safe_fallback(spark, folder):
    learned = F.when(c("unit_id") % 80 == 0, float("nan")).when(c("unit_id") % 40 != 0, c("tokens").cast("double"))
    return features(spark, folder).select("task_id", "unit_id", safe_score(learned, F.round("heuristic_score", 3), c("task_id")).alias("score"))


_SHADOW = f"(SELECT task_id, unit_id, row_number() OVER (PARTITION BY task_id ORDER BY heuristic_score DESC, unit_id) AS rank FROM {FEATURES})"


@query(f"SELECT a.task_id, a.unit_id, a.rank AS production_rank, b.rank AS shadow_rank FROM {_RANKED} a JOIN {_SHADOW} b USING (task_id, unit_id)")
def m06_shadow_ranking(spark, folder):
    shadow = ranked(features(spark, folder), "task_id", "heuristic_score", "unit_id").select("task_id", "unit_id", c("rank").alias("shadow_rank"))
    return w01_rank(spark, folder).join(shadow, ["task_id", "unit_id"]).select("task_id", "unit_id", c("rank").alias("production_rank"), "shadow_rank")


@query(f"""SELECT task_id, count(*) FILTER (WHERE a AND b) AS shared, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE b AND NOT a) AS only_b, round(count(*) FILTER (WHERE a AND b) / count(*), 4) AS jaccard
  FROM (SELECT task_id, unit_id, coalesce(x.rank <= 3, false) AS a, coalesce(y.rank <= 3, false) AS b FROM {_RANKED} x JOIN {_SHADOW} y USING (task_id, unit_id)) WHERE a OR b GROUP BY task_id""")
def u02_top_k_overlap(spark, folder):
    a, b = c("production_rank") <= 3, c("shadow_rank") <= 3
    rows = m06_shadow_ranking(spark, folder).select("task_id", a.alias("a"), b.alias("b")).filter("a or b")
    shared = F.count_if(c("a") & c("b"))
    return rows.groupBy("task_id").agg(shared.alias("shared"), F.count_if(c("a") & ~c("b")).alias("only_a"), F.count_if(~c("a") & c("b")).alias("only_b"), F.round(shared / F.count(F.lit(1)), 4).alias("jaccard"))


@query("SELECT a.l_orderkey AS task_id, a.l_partkey AS unit_id, a.l_returnflag AS resolution_a, b.l_linestatus AS resolution_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey AND a.l_linenumber = b.l_linenumber WHERE a.l_returnflag <> b.l_linestatus")
def u03_resolution_differences(spark, folder):
    keys = ["l_orderkey", "l_partkey", "l_linenumber"]
    a, b = table(spark, folder, "lineitem").select(*keys, c("l_returnflag").alias("resolution_a")), table(spark, folder, "lineitem").select(*keys, c("l_linestatus").alias("resolution_b"))
    return a.join(b, keys).filter("resolution_a <> resolution_b").select(c("l_orderkey").alias("task_id"), c("l_partkey").alias("unit_id"), "resolution_a", "resolution_b")


@query("""WITH r AS (SELECT user_id AS task_id, event_id AS unit_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, event_type = 'error' AS d FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY task_id, rank > 12 AND d ORDER BY rank) AS nth FROM r), l AS (SELECT *, CASE WHEN rank <= 12 THEN 0 WHEN d AND nth <= 8 THEN 1 ELSE 2 END AS level FROM n)
  SELECT task_id, unit_id, level FROM l QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY level, rank) <= 20""")
def k05_shadow_candidates(spark, folder):
    rows = ranked(table(spark, folder, "events").select(c("user_id").alias("task_id"), c("event_id").alias("unit_id"), "value", (c("event_type") == "error").alias("is_diverse")), "task_id", "value", "unit_id")
    return shadow_candidates(rows).select("task_id", "unit_id", "level")


_WORDS = "list_filter(regexp_split_to_array(lower(prompt), '\\W+'), lambda k: length(k) > 2)"


@query(f"""WITH {_FLOW} SELECT task_id, unit_id, hits, CASE WHEN hits >= 4 THEN 'ROOT' WHEN hits >= 1 OR contains(path, 'types') OR contains(path, 'models') THEN 'TYPE' ELSE 'DEAD' END AS class FROM
  (SELECT task_id, unit_id, lower(path) AS path, (3 * len(list_filter(k, lambda w: contains(lower(path), w))) + 2 * len(list_filter(k, lambda w: contains(lower(content), w))))::INT AS hits
   FROM fused JOIN {UNITS} USING (unit_id) JOIN (SELECT task_id, {_WORDS} AS k FROM t) USING (task_id))""")
def r22_relevance_gate(spark, folder):
    """Every candidate of every task, over all channels."""
    words = F.filter(F.split(F.lower("prompt"), r"\W+"), lambda k: F.length(k) > 2)
    rows = fused_candidates(spark, folder).select("task_id", "unit_id").join(units(spark, folder).select("unit_id", "path", "content"), "unit_id").join(tasks(spark, folder).select("task_id", words.alias("k")), "task_id")
    rows = rows.withColumns({"path": F.lower("path"), "content": F.lower("content")})
    hits = 3 * F.size(F.filter("k", lambda w: F.contains(F.col("path"), w))) + 2 * F.size(F.filter("k", lambda w: F.contains(F.col("content"), w)))
    rows = rows.select("task_id", "unit_id", "path", hits.alias("hits"))
    return rows.select("task_id", "unit_id", "hits", F.when(c("hits") >= 4, "ROOT").when((c("hits") >= 1) | c("path").contains("types") | c("path").contains("models"), "TYPE").otherwise("DEAD").alias("class"))


def _provider(row):
    """An offline provider that fails as real ones do: never in time, too often at first, or with an answer that can't be read."""
    kind = row["unit_id"] % 27
    if kind == 0:
        raise ProviderFailure("TIMEOUT")
    if kind == 9:
        raise ProviderFailure("RATE_LIMITED")
    if kind == 18:
        return {"relevance": "much"}
    return {"relevance": 0.5, "implementation": True, "edit_target": False, "root_cause": False}


@query(f"""SELECT task_id, unit_id, CASE WHEN reason = 'NONE' THEN 'OK' ELSE 'FALLBACK' END AS status, reason, CASE reason WHEN 'TIMEOUT' THEN 2 WHEN 'RATE_LIMITED' THEN 2 WHEN 'NONE' THEN 1 WHEN 'MALFORMED_RESPONSE' THEN 1 ELSE 0 END AS tries, CASE WHEN reason = 'NONE' THEN 0.5 ELSE 0.0 END::DOUBLE AS relevance FROM
  (SELECT task_id, unit_id, CASE WHEN task_id % 13 = 0 THEN 'RIGHTS_DENIED' WHEN unit_id % 7 = 0 THEN 'TRUST_DENIED' WHEN rank > 2 THEN 'BUDGET_EXHAUSTED' WHEN unit_id % 27 = 0 THEN 'TIMEOUT' WHEN unit_id % 27 = 9 THEN 'RATE_LIMITED' WHEN unit_id % 27 = 18 THEN 'MALFORMED_RESPONSE' ELSE 'NONE' END AS reason FROM
   (SELECT task_id, unit_id, row_number() OVER (PARTITION BY task_id ORDER BY rank, unit_id) AS rank FROM {_RANKED}))""")
def r24_shadow_judgments(spark, folder):
    """A provider's answers for each task's first two candidates, within its rights, trust and budget, with the reasons of fallbacks."""
    none = F.lit(None).cast("int")
    rows = w01_rank(spark, folder).select("task_id", "unit_id", "rank", F.lit("").alias("prompt"), F.lit("p").alias("path"), F.lit("t").alias("title"), none.alias("distance"), F.lit(False).alias("in_evidence"), F.lit(False).alias("is_direct_dependency"))
    rows = rows.withColumns({"rights": c("task_id") % 13 != 0, "trusted": c("unit_id") % 7 != 0})
    return shadow_run(local_judgment(rows), _provider, calls=2).select("task_id", "unit_id", "status", "reason", "tries", "relevance")
