"""Queries of retrieval and fusion."""

from pyspark.sql import functions as F

from tessera.functions.text import exact_tokens, lexical_tokens, token_estimate
from tessera.operators.flow import channels
from tessera.operators.lexical import LexicalIndex, lexical_scores, query_terms
from tessera.operators.retrieval import containing, exact_matches, frame_matches, fuse, fusion_score, shared_overlap_ratios, top_per
from tessera.registry import query
from tessera.sources.tables import EVIDENCE, TASKS, UNIT_COMMITS, UNIT_CUTOFF, UNIT_EDGES, UNITS, evidence, table, tasks, unit_commits, unit_edges, units
from tessera.storage import new_folder, shared_folder

_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9_]+'), lambda x: length(x) >= 3)"
_EXACT = "list_distinct(list_filter(regexp_split_to_array({0}, '[^A-Za-z0-9_./-]+'), lambda x: length(x) >= 3))"

_SCORES = f"""(WITH terms AS (SELECT DISTINCT task_id, term FROM (SELECT task_id, unnest({_TOKENS.format('prompt')}) AS term FROM {TASKS} UNION ALL SELECT task_id, unnest({_TOKENS.format('message')}) FROM {EVIDENCE}) WHERE task_id IN (SELECT task_id FROM {TASKS})),
  words AS (SELECT unit_id, len(ts) AS size, unnest(ts) AS term FROM (SELECT unit_id, {_TOKENS.format("(title || ' ' || path)")} AS ts FROM {UNITS})),
  counts AS (SELECT unit_id, size, term, count(*) AS tf FROM words GROUP BY ALL)
  SELECT task_id, unit_id, round(sum(ln(1 + tf)) / sqrt(any_value(size)), 4) AS lexical_score FROM counts JOIN terms USING (term)
  GROUP BY task_id, unit_id HAVING round(sum(ln(1 + tf)) / sqrt(any_value(size)), 4) > 0)"""


@query(f"SELECT unit_id, array_to_string({_TOKENS.format('content')}, ' ') AS tokens FROM {UNITS}")
def r01_lexical_tokens(spark, folder):
    return units(spark, folder).select("unit_id", F.array_join(lexical_tokens(F.col("content")), " ").alias("tokens"))


@query(f"SELECT unit_id, array_to_string(list_sort({_EXACT.format('content')}), ' ') AS tokens FROM {UNITS}")
def r02_exact_tokens(spark, folder):
    return units(spark, folder).select("unit_id", F.array_join(F.array_sort(exact_tokens(F.col("content"))), " ").alias("tokens"))


@query(f"SELECT * FROM {_SCORES}")
def r03_lexical_scores(spark, folder):
    return lexical_scores(tasks(spark, folder), units(spark, folder), evidence(spark, folder))


_INDEXES: dict[tuple[str, str, str], str] = {}


def lexical_index(spark, folder):
    """The index of a folder's units, written once in an application and shared folder."""
    key = spark.sparkContext.applicationId, shared_folder(spark), folder
    if key not in _INDEXES:
        path = new_folder(spark, "lexical-index")
        LexicalIndex.build(units(spark, folder), path)
        _INDEXES[key] = path
    return LexicalIndex.open(spark, _INDEXES[key])


def lexical_top(spark, folder, k):
    return lexical_index(spark, folder).top(query_terms(tasks(spark, folder), evidence(spark, folder)), k)


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY lexical_score DESC, unit_id) AS rank FROM {_SCORES}) WHERE rank <= 100")
def k01_lexical_top100(spark, folder):
    return lexical_top(spark, folder, 100)


def _prompts(spark, folder):
    """Customers' orders as prompts that name parts: text with paths, names and chaff."""
    lines = table(spark, folder, "lineitem")
    said = F.concat(F.lit("fix "), F.when(F.col("l_partkey") % 3 == 0, F.lit("src/p_")).when(F.col("l_partkey") % 3 == 1, F.lit("p_")).otherwise("Part.p_"), F.col("l_partkey").cast("string"), F.lit(" please"))
    return lines.groupBy(F.col("l_orderkey").alias("task_id")).agg(F.array_join(F.array_sort(F.collect_list(said)), ", ").alias("prompt"))


def _symbols(spark, folder):
    key = F.col("p_partkey").cast("string")
    return table(spark, folder, "part").select(F.col("p_partkey").alias("unit_id"), F.concat(F.lit("src/p_"), key).alias("path"), F.concat(F.lit("Part.p_"), key).alias("qualified_name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("p_"), key)).alias("name"))


_PROMPTS = "(SELECT l_orderkey AS task_id, string_agg(s, ', ' ORDER BY s) AS prompt FROM (SELECT l_orderkey, 'fix ' || CASE l_partkey % 3 WHEN 0 THEN 'src/p_' WHEN 1 THEN 'p_' ELSE 'Part.p_' END || l_partkey || ' please' AS s FROM lineitem) GROUP BY l_orderkey)"
_SYMBOLS = "(SELECT p_partkey AS unit_id, 'src/p_' || p_partkey AS path, 'Part.p_' || p_partkey AS qualified_name, CASE WHEN p_partkey % 2 = 0 THEN 'p_' || p_partkey END AS name FROM part)"


def _reports(spark, folder):
    """Evidence of every order with a first line: an issue, a trace or a message that names a part."""
    lines = table(spark, folder, "lineitem").filter("l_linenumber = 1")
    part = F.col("l_partkey").cast("string")
    kind = F.col("l_partkey") % 4
    return lines.select(F.col("l_orderkey").alias("task_id"), F.when(kind == 0, F.concat(F.lit("p_"), part, F.lit(" breaks"))).alias("title"), F.when(F.col("l_partkey") % 8 == 0, F.concat(F.lit("Part.p_"), part)).alias("body"),
                        F.when(kind == 1, F.concat(F.lit("at src/p_"), part, F.lit(":1"))).alias("trace"), F.when(kind < 3, F.concat(F.lit("(p_"), part, F.lit("1)"))).alias("message"))


_REPORTS = """(SELECT l_orderkey AS task_id, CASE WHEN l_partkey % 4 = 0 THEN concat_ws(' ', 'p_' || l_partkey || ' breaks', CASE WHEN l_partkey % 8 = 0 THEN 'Part.p_' || l_partkey END) WHEN l_partkey % 4 = 1 THEN 'at src/p_' || l_partkey || ':1'
  WHEN l_partkey % 4 = 2 THEN '(p_' || l_partkey || '1)' END AS text FROM lineitem WHERE l_linenumber = 1)"""


@query(f"""WITH t AS (SELECT task_id, unnest({_EXACT.format('prompt')}) AS token FROM {_PROMPTS} UNION SELECT task_id, unnest({_EXACT.format('text')}) FROM {_REPORTS}),
  k AS (SELECT unit_id, path AS token, 1 AS p FROM {_SYMBOLS} UNION ALL SELECT unit_id, split_part(path, '/', -1), 1 FROM {_SYMBOLS} UNION ALL SELECT unit_id, qualified_name, 2 FROM {_SYMBOLS} UNION ALL SELECT unit_id, name, 3 FROM {_SYMBOLS}),
  m AS (SELECT task_id, unit_id, p FROM t JOIN k USING (token))
  SELECT task_id, unit_id, ['path', 'qualified_name', 'symbol_name'][min(p)] AS match_type FROM m GROUP BY task_id, unit_id""")
def j02_exact_retrieval(spark, folder):
    return exact_matches(_prompts(spark, folder), _symbols(spark, folder), _reports(spark, folder))


def _frames(spark, folder):
    """Frames with absolute, relative and cut paths, and functions in other cases, qualified or unknown."""
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    file = F.when(k % 4 == 0, F.concat(F.lit("C:\\Work\\SRC\\P_"), key)).when(k % 4 == 1, F.concat(F.lit("p_"), key)).when(k % 4 == 2, F.substring(key, 2, 9)).otherwise(F.concat(F.lit("/x/data"), key))
    near = (k - k % 20).cast("string")
    function = F.when(k % 3 == 0, F.concat(F.lit("P_"), near)).when(k % 3 == 1, F.concat(F.lit("art.P_"), near))
    return table(spark, folder, "part").select((k % 50).alias("task_id"), file.alias("file"), function.alias("function"))


_FRAMES = r"""(SELECT p_partkey % 50 AS task_id, CASE p_partkey % 4 WHEN 0 THEN 'C:\Work\SRC\P_' || p_partkey WHEN 1 THEN 'p_' || p_partkey WHEN 2 THEN substr(p_partkey::VARCHAR, 2, 9) ELSE '/x/data' || p_partkey END AS file,
  CASE p_partkey % 3 WHEN 0 THEN 'P_' || (p_partkey - p_partkey % 20) WHEN 1 THEN 'art.P_' || (p_partkey - p_partkey % 20) END AS function FROM part)"""


def _framed(spark, folder):
    """Parts as units; some have short paths that others end with."""
    key = F.col("unit_id").cast("string")
    return _symbols(spark, folder).withColumn("path", F.when(F.col("unit_id") % 5 == 4, F.concat(F.lit("a"), key)).otherwise(F.col("path")))


@query(f"""WITH f AS (SELECT DISTINCT task_id, lower(function) AS function, lower(replace(file, '\\', '/')) AS file FROM {_FRAMES} WHERE file <> ''),
  u AS (SELECT unit_id, lower(name) AS name, lower(qualified_name) AS qualified, CASE WHEN unit_id % 5 = 4 THEN 'a' || unit_id ELSE path END AS path FROM {_SYMBOLS})
  SELECT task_id, unit_id, max(CASE WHEN coalesce(function <> '' AND (function = name OR ends_with(qualified, function)), false) THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END) AS confidence FROM f JOIN u
  ON ends_with(file, path) OR ends_with(path, file) GROUP BY ALL""")
def j03_stack_frame_suffix(spark, folder):
    return frame_matches(_frames(spark, folder), _framed(spark, folder))


@query(f"SELECT t.task_id, u.unit_id FROM {UNITS} u JOIN {TASKS} t ON contains(u.content, t.passage)")
def j04_containment(spark, folder):
    return containing(units(spark, folder), tasks(spark, folder), "content", "passage").select("task_id", "unit_id")


@query(f"SELECT unit_id, path, EXISTS (SELECT 1 FROM (SELECT 'doc_' || s_suppkey || '.' AS dirty FROM supplier) d WHERE contains(path, dirty) OR contains(dirty, path)) AS in_dirty_diff FROM {UNITS}")
def j05_dirty_overlap(spark, folder):
    dirty = table(spark, folder, "supplier").select(F.concat(F.lit("doc_"), F.col("s_suppkey").cast("string"), F.lit(".")).alias("dirty"))
    u = units(spark, folder).select("unit_id", "path")
    hits = containing(u, dirty, "path", "dirty", either=True).select("unit_id").distinct().withColumn("hit", F.lit(True))
    return u.join(hits, "unit_id", "left").select("unit_id", "path", F.coalesce("hit", F.lit(False)).alias("in_dirty_diff"))


#: All channels as tables of a query: exact, lex, runtime, seeds0, graph, change, and their union fused.
_FLOW = f"""u AS (SELECT unit_id, path, title, kind FROM {UNITS}), t AS (SELECT * FROM {TASKS}), e AS (SELECT DISTINCT src, dst, kind FROM {UNIT_EDGES}), ev AS (SELECT * FROM {EVIDENCE}), hist AS (SELECT sha, ts, lower(file) AS file FROM {UNIT_COMMITS} WHERE ts <= TIMESTAMP '{UNIT_CUTOFF}'),
  exact AS (SELECT DISTINCT task_id, unit_id FROM (SELECT task_id, unnest({_EXACT.format('prompt')}) AS token FROM t UNION SELECT task_id, unnest({_EXACT.format("coalesce(title || coalesce(' ' || body, ''), trace, message)")}) FROM ev WHERE task_id IN (SELECT task_id FROM t)) JOIN (SELECT unit_id, path AS token FROM u UNION SELECT unit_id, split_part(path, '/', -1) FROM u) USING (token)),
  lex AS (SELECT task_id, unit_id, lexical_score FROM {_SCORES} QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY lexical_score DESC, unit_id) <= 100),
  runtime AS (SELECT DISTINCT task_id, unit_id FROM ev JOIN u ON ends_with(lower(ev.path), lower(u.path)) OR ends_with(lower(u.path), lower(ev.path)) WHERE ev.kind <> 'COMPILER_ERROR'),
  seeds0 AS (SELECT task_id, unit_id FROM exact UNION SELECT task_id, unit_id FROM lex UNION SELECT task_id, unit_id FROM runtime),
  sym AS (SELECT src, dst, kind FROM e UNION SELECT dst, src, kind FROM e),
  one AS (SELECT unit_id AS root, dst AS node, min(kind) AS path FROM (SELECT DISTINCT unit_id FROM seeds0) JOIN sym ON src = unit_id WHERE dst <> unit_id GROUP BY ALL),
  two AS (SELECT root, dst AS node, min(path || '>' || kind) AS path FROM one JOIN sym ON src = node WHERE dst <> root AND NOT EXISTS (SELECT 1 FROM one o WHERE o.root = one.root AND o.node = dst) GROUP BY ALL),
  graph AS (SELECT task_id, node AS unit_id, min(d)::INT AS graph_distance, bool_or(list_contains(string_split(path, '>'), 'TESTS')) AS test_relationship FROM seeds0 JOIN (SELECT *, 1 AS d FROM one UNION ALL SELECT *, 2 FROM two) ON root = unit_id GROUP BY task_id, node),
  held AS (SELECT task_id, unit_id FROM seeds0 UNION SELECT task_id, unit_id FROM graph),
  co AS (SELECT a.file AS file, b.file AS other, count(*) / any_value(n.total) AS score FROM hist a JOIN hist b ON a.sha = b.sha AND a.file <> b.file JOIN (SELECT file, count(*) AS total FROM hist GROUP BY file) n ON n.file = a.file GROUP BY ALL HAVING count(*) >= 3 AND count(*) / any_value(n.total) >= 0.15),
  change AS (SELECT h.task_id, y.unit_id, max(score) AS co_change_score FROM held h JOIN u x ON x.unit_id = h.unit_id JOIN co ON co.file = lower(x.path) JOIN u y ON lower(y.path) = co.other GROUP BY ALL),
  fused AS (SELECT task_id, unit_id, max(lexical_score) AS lexical_score, min(graph_distance) AS graph_distance, max(co_change_score) AS co_change_score, coalesce(bool_or(exact_match), false) AS exact_match, coalesce(bool_or(test_relationship), false) AS test_relationship,
   coalesce(bool_or(runtime_match), false) AS runtime_match, list_sort(list(DISTINCT source)) AS sources FROM (
   SELECT task_id, unit_id, 'lexical' AS source, lexical_score, NULL::INT AS graph_distance, NULL::DOUBLE AS co_change_score, NULL::BOOLEAN AS exact_match, NULL::BOOLEAN AS test_relationship, NULL::BOOLEAN AS runtime_match FROM lex
   UNION ALL SELECT task_id, unit_id, 'exact', NULL, NULL, NULL, true, NULL, NULL FROM exact UNION ALL SELECT task_id, unit_id, 'graph', NULL, graph_distance, NULL, NULL, test_relationship, NULL FROM graph
   UNION ALL SELECT task_id, unit_id, 'git_co_change', NULL, NULL, co_change_score, NULL, NULL, NULL FROM change UNION ALL SELECT task_id, unit_id, 'stack_trace', NULL, NULL, NULL, NULL, NULL, true FROM runtime) GROUP BY task_id, unit_id)"""
_FUSED = f"(WITH {_FLOW} SELECT * FROM fused)"
_SCORE = "(CASE WHEN exact_match THEN 5 ELSE 0 END + CASE WHEN runtime_match THEN 6 ELSE 0 END + CASE WHEN test_relationship THEN 2 ELSE 0 END + 2 * coalesce(lexical_score, 0) + 2 * coalesce(co_change_score, 0) + CASE WHEN graph_distance IS NULL THEN 0 ELSE greatest(0, 3 - graph_distance) END + len(sources))"


def flow_inputs(spark, folder):
    """tasks, evidence, units, edges and commits, as the channels take them."""
    return tasks(spark, folder), evidence(spark, folder), units(spark, folder), unit_edges(spark, folder), unit_commits(spark, folder)


def fused_candidates(spark, folder):
    return fuse(channels(*flow_inputs(spark, folder), UNIT_CUTOFF, index=lexical_index(spark, folder)))


@query(f"SELECT * EXCLUDE (sources, co_change_score), round(co_change_score, 6) AS co_change_score, array_to_string(sources, ',') AS sources FROM {_FUSED}")
def u01_channel_union(spark, folder):
    return fused_candidates(spark, folder).withColumn("sources", F.array_join("sources", ",")).withColumn("co_change_score", F.round("co_change_score", 6))


@query(f"SELECT task_id, unit_id, round({_SCORE}, 4) AS fusion_score FROM {_FUSED}")
def r04_fusion_scores(spark, folder):
    return fused_candidates(spark, folder).select("task_id", "unit_id", F.round(fusion_score(), 4).alias("fusion_score"))


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY fusion_score DESC, unit_id) AS rank FROM (SELECT task_id, unit_id, round({_SCORE}, 4) AS fusion_score FROM {_FUSED})) WHERE rank <= 200")
def k02_fusion_top200(spark, folder):
    return top_per(fused_candidates(spark, folder).select("task_id", "unit_id", F.round(fusion_score(), 4).alias("fusion_score")), "task_id", "fusion_score", "unit_id", 200)


@query(f"""WITH q AS (SELECT task_id, unnest({_TOKENS.format('prompt')}) AS w, len({_TOKENS.format('prompt')}) AS n FROM {TASKS}), u AS (SELECT DISTINCT unit_id, unnest({_TOKENS.format('content')}) AS w FROM {UNITS})
  SELECT task_id, unit_id, round(count(*) / any_value(n), 6) AS overlap_ratio FROM q JOIN u USING (w) GROUP BY task_id, unit_id""")
def r05_overlap_ratio(spark, folder):
    """Of every task and unit that share a token."""
    return shared_overlap_ratios(tasks(spark, folder), units(spark, folder)).withColumn("overlap_ratio", F.round("overlap_ratio", 6))


@query(f"""SELECT unit_id, CAST(CASE WHEN known > 0 THEN known WHEN ceil(length(c) / 4) > 0 THEN ceil(length(c) / 4) WHEN lines > 0 THEN greatest(10, lines * 8) ELSE 50 END AS BIGINT) AS token_estimate
  FROM (SELECT unit_id, CASE unit_id % 4 WHEN 0 THEN tokens WHEN 1 THEN 0 END AS known, CASE WHEN unit_id % 3 = 0 THEN content ELSE '' END AS c, CASE WHEN unit_id % 5 < 3 THEN unit_id % 5 END AS lines FROM {UNITS})""")
def r06_token_estimate(spark, folder):
    known = F.when(F.col("unit_id") % 4 == 0, F.col("tokens")).when(F.col("unit_id") % 4 == 1, 0)
    lines = F.when(F.col("unit_id") % 5 < 3, F.col("unit_id") % 5)
    return units(spark, folder).select("unit_id", token_estimate(known, F.when(F.col("unit_id") % 3 == 0, F.col("content")).otherwise(""), lines).alias("token_estimate"))


@query(f"SELECT c.l_orderkey AS task_id, u.unit_id, u.path, u.tokens FROM lineitem c JOIN {UNITS} u ON u.unit_id = c.l_partkey")
def j01_candidate_unit_lookup(spark, folder):
    candidates = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_partkey").alias("unit_id"))
    return candidates.join(units(spark, folder), "unit_id").select("task_id", "unit_id", "path", "tokens")
