"""The flow from prompts to packed context, over all channels."""

from pyspark.sql import functions as F

from tessera.operators.flow import build_features, candidates, pack, rank_features
from tessera.operators.judgments import local_judgment
from tessera.operators.packing import plan_totals
from tessera.plans.ranking import _H, _RANK_SCORE
from tessera.plans.retrieval import _FLOW, _SCORE, _TOKENS, flow_inputs, lexical_index
from tessera.registry import query
from tessera.sources.tables import DIRTY, TASK_SEEDS, UNIT_CUTOFF, UNITS, dirty_paths, task_seeds

MOST = 50


def c(name):
    return F.col(name)


#: Feature rows of each task's first candidates, as SQL.
_ROWS = f"""WITH RECURSIVE {_FLOW}, top AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY round({_SCORE}, 6) DESC, unit_id) AS place FROM fused QUALIFY place <= {MOST}),
  w AS (SELECT unit_id, kind, path, title, content, tokens FROM {UNITS}), s AS (SELECT DISTINCT task_id, unit_id AS seed FROM {TASK_SEEDS}), dirty AS (SELECT * FROM {DIRTY}),
  step AS (SELECT DISTINCT src, dst FROM e),
  near(root, node, d) AS (SELECT DISTINCT seed, seed, 0 FROM s UNION SELECT near.root, step.dst, near.d + 1 FROM near JOIN step ON step.src = near.node WHERE near.d < 5),
  nodes AS (SELECT src AS unit_id FROM e UNION SELECT dst FROM e),
  err AS (SELECT DISTINCT ev.task_id, w.unit_id AS root FROM ev JOIN w ON contains(w.path, ev.path) OR contains(ev.path, w.path) WHERE w.unit_id IN (SELECT unit_id FROM nodes)),
  far(root, node, d) AS (SELECT DISTINCT root, root, 0 FROM err UNION SELECT far.root, step.dst, far.d + 1 FROM far JOIN step ON step.src = far.node WHERE far.d < 5),
  bs AS (SELECT task_id, unit_id, min(d) AS ds, bool_or(d = 1 AND EXISTS (SELECT 1 FROM e WHERE e.src = unit_id AND e.dst = seed)) AS dep, bool_or(d = 1) AS dent FROM (SELECT top.task_id, top.unit_id, seed, min(near.d) AS d FROM top JOIN s USING (task_id) JOIN near ON near.root = seed AND near.node = top.unit_id GROUP BY ALL) GROUP BY ALL),
  be AS (SELECT top.task_id, top.unit_id, min(far.d) AS de FROM top JOIN err USING (task_id) JOIN far ON far.root = err.root AND far.node = top.unit_id GROUP BY ALL),
  deg AS (SELECT unit_id, count(*) AS n FROM (SELECT src AS unit_id FROM {{edges}} UNION ALL SELECT dst FROM {{edges}}) GROUP BY ALL),
  seen AS (SELECT top.task_id, top.unit_id, bool_or(ev.kind = 'STACK_TRACE') AS a, bool_or(ev.kind = 'TEST_FAILURE') AS b, bool_or(ev.kind = 'COMPILER_ERROR') AS x FROM top JOIN w USING (unit_id) JOIN ev ON ev.task_id = top.task_id AND contains(ev.path, w.path) GROUP BY ALL),
  raw AS (SELECT sha, ts, file FROM {{commits}} WHERE ts <= TIMESTAMP '{UNIT_CUTOFF}'),
  freq AS (SELECT file, count(DISTINCT sha) AS changes, count(DISTINCT sha) FILTER (WHERE ts >= TIMESTAMP '{UNIT_CUTOFF}' - INTERVAL 30 DAYS) AS recent FROM raw GROUP BY file),
  pairs AS (SELECT DISTINCT a.path AS a, b.path AS b, top.task_id, top.unit_id FROM top JOIN w b USING (unit_id) JOIN s USING (task_id) JOIN w a ON a.unit_id = seed WHERE a.path <> b.path),
  cc AS (SELECT task_id, unit_id, max(coalesce(n, 0) / total) AS co FROM pairs JOIN (SELECT file, count(*) AS total FROM raw GROUP BY file) t ON t.file = a LEFT JOIN (SELECT x.file AS xf, y.file AS yf, count(*) AS n FROM raw x JOIN raw y ON x.sha = y.sha GROUP BY ALL) z ON xf = a AND yf = b GROUP BY ALL),
  q AS (SELECT task_id, prompt, {_TOKENS.format('prompt')} AS qt FROM t),
  f0 AS (SELECT top.task_id, top.unit_id, w.kind, w.path, false AS unsafe, w.content, coalesce(nullif(w.tokens, 0), 50)::BIGINT AS tokens, w.kind = 'TEST' OR contains(lower(w.path), 'test') AS is_test,
   exact_match OR contains(lower(prompt), lower(title)) AS exact_symbol_match, contains(lower(prompt), lower(w.path)) AS exact_path_match, lexical_score AS ls,
   len(list_filter(qt, lambda k: list_contains({_TOKENS.format("(w.path || ' ' || w.unit_id || ' ' || w.content || ' ' || title)")}, k))) / len(qt) AS token_overlap_ratio, sources
   FROM top JOIN w USING (unit_id) JOIN q USING (task_id)),
  f AS (SELECT f0.task_id, f0.unit_id, f0.kind, f0.path, f0.tokens, f0.is_test, f0.exact_symbol_match, f0.exact_path_match, coalesce(ls, token_overlap_ratio * 10) AS lexical_score, token_overlap_ratio, coalesce(deg.n, 0)::INT AS graph_degree, ds AS min_distance_to_seed, de AS min_distance_to_error_frame,
   coalesce(dep, false) AS is_direct_dependency, coalesce(dent, false) AS is_direct_dependent, coalesce(seen.a, false) AS in_stack_trace, coalesce(seen.b, false) AS is_failing_test_target, coalesce(seen.x, false) AS in_compiler_error,
   EXISTS (SELECT 1 FROM dirty WHERE dirty.task_id = f0.task_id AND (contains(f0.path, dirty.path) OR contains(dirty.path, f0.path))) AS in_dirty_diff, coalesce(changes, 0)::INT AS changes, coalesce(recent, 0)::INT AS recent_changes, coalesce(co, 0)::DOUBLE AS max_co_change, sources,
   NULL::DOUBLE AS semantic, NULL::DOUBLE AS implementation, NULL::DOUBLE AS edit_target, NULL::DOUBLE AS root_cause, NULL::DOUBLE AS confidence
   FROM f0 LEFT JOIN deg USING (unit_id) LEFT JOIN bs USING (task_id, unit_id) LEFT JOIN be USING (task_id, unit_id) LEFT JOIN seen USING (task_id, unit_id) LEFT JOIN freq ON freq.file = f0.path LEFT JOIN cc USING (task_id, unit_id)),
  r AS (SELECT *, {_H} AS heuristic_score FROM f)"""


def _sql(select):
    from tessera.sources.tables import UNIT_COMMITS, UNIT_EDGES

    return _ROWS.replace("{edges}", UNIT_EDGES).replace("{commits}", UNIT_COMMITS) + " " + select


_SHOWN = ["tokens", "is_test", "exact_symbol_match", "exact_path_match", "graph_degree", "min_distance_to_seed", "min_distance_to_error_frame", "is_direct_dependency", "is_direct_dependent", "in_stack_trace", "is_failing_test_target", "in_compiler_error", "in_dirty_diff", "changes", "recent_changes"]
_ROUNDED = ["lexical_score", "token_overlap_ratio", "max_co_change", "heuristic_score"]


def flow_rows(spark, folder):
    inputs = flow_inputs(spark, folder)
    chosen = candidates(*inputs, UNIT_CUTOFF, MOST, index=lexical_index(spark, folder))
    t, ev, u, e, commits = inputs
    return build_features(chosen, t, ev, task_seeds(spark, folder), dirty_paths(spark, folder), u, e, commits, UNIT_CUTOFF)


@query(_sql(f"SELECT task_id, unit_id, {', '.join(_SHOWN)}, {', '.join(f'round({x}, 4)::DOUBLE AS {x}' for x in _ROUNDED)}, array_to_string(sources, ',') AS sources FROM r"))
def r07_built_features(spark, folder):
    """The feature row of each task's first 50 candidates, from its channels, evidence, graph and history up to the cut-off."""
    return flow_rows(spark, folder).select("task_id", "unit_id", *_SHOWN, *[F.round(x, 4).alias(x) for x in _ROUNDED], F.array_join("sources", ",").alias("sources"))


@query(_sql(f"SELECT task_id, unit_id, score, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, unit_id) AS rank FROM (SELECT task_id, unit_id, round({_RANK_SCORE}, 2) AS score FROM r)"))
def flow_ranking(spark, folder):
    """From prompts to ranked candidates."""
    return rank_features(flow_rows(spark, folder)).select("task_id", "unit_id", "score", "rank")


_WORDS = "list_filter(regexp_split_to_array(lower(prompt), '\\W+'), lambda k: length(k) > 2)"


@query(_sql(f"""SELECT task_id, unit_id, matches, round(least(1, 0.2 * matches + CASE d WHEN 1 THEN 0.3 WHEN 2 THEN 0.15 ELSE 0 END + CASE WHEN seen THEN 0.4 ELSE 0 END), 4)::DOUBLE AS relevance, seen OR matches >= 4 OR (matches >= 2 AND coalesce(d = 1, false)) AS edit_target, seen OR (matches >= 3 AND dep) AS root_cause
  FROM (SELECT r.task_id, r.unit_id, min_distance_to_seed AS d, in_stack_trace OR is_failing_test_target AS seen, is_direct_dependency AS dep, coalesce(list_sum(list_transform({_WORDS}, lambda k: CASE WHEN contains(lower(r.path), k) THEN 2 ELSE 0 END + CASE WHEN contains(lower(title), k) THEN 3 ELSE 0 END)), 0)::INT AS matches FROM r JOIN t USING (task_id) JOIN u USING (unit_id))"""))
def r23_local_judgment(spark, folder):
    """The local judgment of each task's first 50 candidates, by its prompt's words, the graph and the evidence."""
    t, _, u, _, _ = flow_inputs(spark, folder)
    rows = flow_rows(spark, folder).select("task_id", "unit_id", "path", c("min_distance_to_seed").alias("distance"), (c("in_stack_trace") | c("is_failing_test_target")).alias("in_evidence"), "is_direct_dependency")
    rows = local_judgment(rows.join(t.select("task_id", "prompt"), "task_id").join(u.select("unit_id", "title"), "unit_id"))
    return rows.select("task_id", "unit_id", "matches", "relevance", "edit_target", "root_cause")


def packed(spark, folder, **options):
    from tessera.sources.tables import evidence, unit_edges

    rows = rank_features(flow_rows(spark, folder))
    return rows, pack(rows, unit_edges(spark, folder), evidence(spark, folder), **options)


@query()
def flow_prompt_to_context(spark, folder):
    """From prompts to the units, resolutions and token costs that are packed: a fold for each task, held against plain Python in the tests."""
    return packed(spark, folder, limit=4000)[1]


@query()
def flow_plan_totals(spark, folder):
    """Tokens and dollars of each task's plan under a ceiling of cost, and what it saves against whole units."""
    rows, plan = packed(spark, folder, limit=16_000, max_cost=0.005)
    return plan_totals(plan.select("task_id", "unit_id").join(rows, ["task_id", "unit_id"]), plan)
