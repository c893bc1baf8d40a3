"""Queries of resolutions and packing."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.text import calibrated_tokens, model_family
from tessera.operators.packing import BODY, FULL, UTILITY, allocated, compose_bundles, fit_rendered, least_useful, model_cost, nearest_safe, resolution_curve, resolution_tokens, solve_budget, supports
from tessera.plans.ranking import FEATURES, features
from tessera.registry import query
from tessera.sources.tables import UNITS, table, units


def c(name):
    return F.col(name)


_ROWS = f"(SELECT *, min_distance_to_seed AS distance, is_direct_dependency OR is_direct_dependent AS is_direct, unit_id % 12 = 5 AS unsafe, row_number() OVER (PARTITION BY task_id ORDER BY unit_id, tokens, token_overlap_ratio, min_distance_to_error_frame NULLS FIRST) AS place FROM {FEATURES})"
_EDIT = "(in_stack_trace OR is_failing_test_target OR in_compiler_error OR in_dirty_diff)"
_CODE = "kind IN ('SOURCE_FILE', 'TEST', 'CODE_SYMBOL')"
_WHOLE = "kind IN ('CONFIG', 'SCHEMA', 'MIGRATION', 'LOCKFILE', 'DOCUMENTATION')"


def rows(spark, folder):
    direct = c("is_direct_dependency") | c("is_direct_dependent")
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("unit_id", "tokens", "token_overlap_ratio", F.col("min_distance_to_error_frame").asc_nulls_first()))
    return features(spark, folder).withColumns({"distance": c("min_distance_to_seed"), "is_direct": direct, "unsafe": c("unit_id") % 12 == 5, "place": place})


def _cost(raw, r):
    return f"CAST(CASE {r} WHEN 5 THEN {raw} WHEN 4 THEN greatest(5, ceil({raw} * 0.75)) WHEN 3 THEN greatest(5, ceil({raw} * 0.25)) WHEN 2 THEN greatest(5, ceil({raw} * 0.10)) WHEN 1 THEN 5 ELSE 0 END AS BIGINT)"


def _alloc(priority, pressure):
    return f"""CASE WHEN {priority} OR {_EDIT} THEN CASE WHEN {pressure} > 1.8 AND tokens > 500 THEN 4 ELSE 5 END WHEN {_WHOLE} THEN CASE WHEN {pressure} > 1.3 THEN 1 ELSE 5 END
  WHEN distance >= 2 THEN CASE WHEN {pressure} > 1.2 OR unsafe THEN 2 ELSE 3 END WHEN coalesce(distance = 1, false) OR is_direct THEN CASE WHEN {pressure} > 1.5 THEN CASE WHEN unsafe THEN 2 ELSE 3 END ELSE 4 END
  WHEN {pressure} > 1.0 OR unsafe THEN 2 ELSE 3 END"""


@query(f"SELECT task_id, unit_id, {_CODE} AND NOT unsafe AS skeleton, {_CODE} AS signature, CASE WHEN {_CODE} THEN CASE WHEN unsafe THEN 2 ELSE 3 END ELSE 1 END AS nearest_to_skeleton FROM {_ROWS}")
def r10_capabilities(spark, folder):
    k, u = c("kind"), c("unsafe")
    return rows(spark, folder).select("task_id", "unit_id", supports(k, u, 3).alias("skeleton"), supports(k, u, 2).alias("signature"), nearest_safe(k, u, F.lit(3)).alias("nearest_to_skeleton"))


@query(f"SELECT task_id, unit_id, {_alloc('place = 1', '(task_id % 5 * 0.5)')} AS resolution FROM {_ROWS}")
def r11_resolution_allocation(spark, folder):
    return rows(spark, folder).select("task_id", "unit_id", allocated(c("place") == 1, c("task_id") % 5 * 0.5).alias("resolution"))


@query(f"SELECT task_id, unit_id, CASE WHEN {_EDIT} THEN 4 WHEN is_direct OR coalesce(distance = 1, false) THEN 2 ELSE 1 END AS resolution FROM {_ROWS}")
def r12_least_useful(spark, folder):
    return rows(spark, folder).select("task_id", "unit_id", least_useful().alias("resolution"))


@query(f"SELECT unit_id, r AS resolution, {_cost('tokens', 'r')} AS token_cost FROM {UNITS}, range(0, 6) x(r)")
def r13_resolution_cost(spark, folder):
    levels = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("resolution")
    return units(spark, folder).select("unit_id", "tokens", levels).select("unit_id", "resolution", resolution_tokens(c("tokens"), c("resolution")).alias("token_cost"))


_ALLOWED = f"CASE r WHEN 3 THEN {_CODE} AND unit_id % 12 <> 5 WHEN 2 THEN {_CODE} ELSE true END"


@query(f"SELECT unit_id, r AS resolution, {_ALLOWED} AS allowed, CASE WHEN {_ALLOWED} THEN {_cost('tokens', 'r')} ELSE 0 END AS token_cost, round((unit_id % 9 / 7.0) * s, 4)::DOUBLE AS utility FROM {UNITS}, (VALUES {', '.join(f'({r}, {s})' for r, s in UTILITY.items())}) v(r, s)")
def r14_resolution_curve(spark, folder):
    u = units(spark, folder).withColumn("unsafe", c("unit_id") % 12 == 5)
    return resolution_curve(u, c("unit_id") % 9 / 7.0)


_LIMIT = 5000


def _levels(sql):
    for level in (4, 3, 2, 1, 0):
        skel = f"AND NOT (unsafe OR {_WHOLE})" if level == 3 else ""
        sql = f"""(SELECT * EXCLUDE (moves, freed, ov, stopped, resolution, cost), CASE WHEN moves AND NOT stopped THEN {level} ELSE resolution END AS resolution, CASE WHEN moves AND NOT stopped THEN cost - freed ELSE cost END AS cost FROM (
      SELECT *, max(CASE WHEN ov <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY heuristic_score, place) = 1 AS stopped FROM (
       SELECT *, sum(cost) OVER (PARTITION BY task_id) - coalesce(sum(freed) OVER (PARTITION BY task_id ORDER BY heuristic_score, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - {_LIMIT} AS ov FROM (
        SELECT *, CASE WHEN moves THEN cost - {_cost('tokens', str(level))} ELSE 0 END AS freed FROM (SELECT *, NOT {_EDIT} AND resolution > {level} {skel} AS moves FROM {sql})))))"""
    return sql


_START = f"(SELECT *, {_cost('tokens', 'resolution')} AS cost FROM (SELECT *, {_alloc('place = 1', f'(raw_total / {_LIMIT})')} AS resolution FROM (SELECT *, sum(tokens) OVER (PARTITION BY task_id) AS raw_total FROM {_ROWS})))"
_UNSAFE_SKELETON = f"resolution = 3 AND (unsafe OR {_WHOLE})"


@query(f"SELECT task_id, unit_id, CASE WHEN {_UNSAFE_SKELETON} THEN 2 ELSE resolution END AS resolution, CAST(CASE WHEN {_UNSAFE_SKELETON} THEN {_cost('tokens', '2')} ELSE cost END AS BIGINT) AS token_cost FROM {_levels(_START)}")
def r16_budget_solver(spark, folder):
    return solve_budget(rows(spark, folder), _LIMIT)


@query()
def r15_greedy_bundle(spark, folder):
    ranked = rows(spark, folder).select("task_id", "unit_id", F.row_number().over(Window.partitionBy("task_id").orderBy(c("heuristic_score").desc(), "unit_id")).alias("rank"), c("heuristic_score").alias("score"), "tokens", F.concat(F.lit("f"), (c("unit_id") % 7).cast("string")).alias("path"))
    links = ranked.alias("a").join(ranked.alias("b"), "task_id").filter("a.unit_id % 5 = b.unit_id % 5 and a.unit_id < b.unit_id").select("task_id", c("a.unit_id").alias("src"), c("b.unit_id").alias("dst"))
    return compose_bundles(ranked, links, ranked.filter("unit_id % 11 = 0").select("task_id", "path"))


@query()
def r17_render_gate(spark, folder):
    plan = rows(spark, folder).select("task_id", "unit_id", "place", "tokens", F.when(c("place") % 2 == 0, FULL).otherwise(BODY).alias("resolution"), F.lit(1).alias("least"), (c("place") == 1).alias("mandatory"), (~c("unsafe")).alias("safe"))
    return fit_rendered(plan, 4000)


_MODELS = ["Claude-3-5-Sonnet-x", "gpt-4o-mini-2024", "GPT-4o", "o1-preview", "cursor-small", "unheard-of"]


@query(f"SELECT unit_id, model, round(tokens * 20 / 1000000 * CASE WHEN contains(lower(model), 'gpt-4o-mini') THEN 0.15 WHEN contains(lower(model), 'gpt-4o') THEN 2.5 WHEN contains(lower(model), 'o1') THEN 15.0 ELSE 3.0 END, 6)::DOUBLE AS cost FROM (SELECT *, {_MODELS}[CAST(unit_id % 6 + 1 AS INT)] AS model FROM {UNITS})")
def r18_model_cost(spark, folder):
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (c("unit_id") % 6 + 1).cast("int"))
    return units(spark, folder).withColumn("model", model).select("unit_id", "model", model_cost(c("tokens") * 20, c("model")).alias("cost"))


@query(f"""SELECT unit_id, CAST(CASE WHEN length(content) = 0 THEN 0 WHEN m IN (0, 4) THEN greatest(1, ceil(ceil(length(content) / 3.7::DOUBLE) * 1.15::DOUBLE)) WHEN m IN (1, 2, 3) THEN greatest(1, ceil(ceil(length(content) / 3.6::DOUBLE) * 1.15::DOUBLE)) ELSE greatest(1, ceil(ceil(length(content) / 3.0::DOUBLE) * 1.35::DOUBLE)) END AS BIGINT) AS tokens FROM (SELECT *, unit_id % 6 AS m FROM {UNITS})""")
def r19_tokenizer_estimate(spark, folder):
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (c("unit_id") % 6 + 1).cast("int"))
    return units(spark, folder).select("unit_id", calibrated_tokens(F.length("content"), model_family(model)).alias("tokens"))


@query(f"""SELECT unit_id, sha256(body) AS sha, CAST(ceil(length(body) / 4) AS BIGINT) AS tokens FROM (SELECT unit_id, CASE unit_id % 4 WHEN 0 THEN title WHEN 1 THEN regexp_split_to_array(content, chr(10))[1] WHEN 2 THEN array_to_string(regexp_split_to_array(content, chr(10))[2:4], chr(10)) ELSE content END AS body FROM {UNITS})""")
def r20_materialize(spark, folder):
    lines = F.split("content", "\n", -1)
    k = c("unit_id") % 4
    body = F.when(k == 0, c("title")).when(k == 1, F.get(lines, F.lit(0))).when(k == 2, F.array_join(F.slice(lines, 2, 3), "\n")).otherwise(c("content"))
    return units(spark, folder).withColumn("body", body).select("unit_id", F.sha2("body", 256).alias("sha"), F.ceil(F.length("body") / 4).cast("long").alias("tokens"))


@query("SELECT l_orderkey AS task_id, count(*) AS units, array_to_string(list(l_partkey ORDER BY l_partkey, l_linenumber), ',') AS unit_ids FROM lineitem GROUP BY ALL")
def r15_bundle_lists(spark, folder):
    lines = table(spark, folder, "lineitem")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber"))), lambda x: x["l_partkey"].cast("string"))
    return lines.groupBy(c("l_orderkey").alias("task_id")).agg(F.count(F.lit(1)).alias("units"), F.array_join(ids, ",").alias("unit_ids"))
