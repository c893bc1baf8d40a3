"""The tables of a data folder, and the views by which they stand for units, tasks, commits, edges and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: File names by language of a document: code, tests, documentation, configuration.
NAMES = {"en": ("SOURCE_FILE", "src", ".ts"), "de": ("TEST", "tests", ".test.ts"), "fr": ("DOCUMENTATION", "docs", ".md"), "es": ("CONFIG", "conf", ".config.json")}


def _by_lang(place: int) -> str:
    return "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v[place]}'" for k, v in NAMES.items()) + f" ELSE '{NAMES['en'][place]}' END"


def units(spark: SparkSession, folder: str) -> DataFrame:
    """unit_id, repository_id, kind, path, title, content, tokens, n_chars, lang."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("unit_id"),
        F.col("source").alias("repository_id"),
        F.expr(_by_lang(0)).alias("kind"),
        F.concat(F.col("source"), F.lit("/"), F.expr(_by_lang(1)), F.lit("/doc_"), F.col("doc_id").cast("string"), F.expr(_by_lang(2))).alias("path"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("content"),
        F.ceil(F.col("n_chars") / 4).cast("long").alias("tokens"),
        "n_chars",
        "lang",
    )


UNITS = f"""(SELECT doc_id AS unit_id, source AS repository_id, {_by_lang(0)} AS kind,
  source || '/' || {_by_lang(1)} || '/doc_' || doc_id || {_by_lang(2)} AS path, 'doc_' || doc_id AS title, text AS content,
  CAST(ceil(n_chars / 4) AS BIGINT) AS tokens, n_chars, lang FROM documents)"""


#: What a task's prompt says after its passage: two units by title, and in every tenth one all tests.
_MENTION = "concat(' see doc_', CAST(item_id * 3 AS {0}), '.ts and DOC_', CAST(item_id * 3 + 1 AS {0}), CASE WHEN item_id % 10 = 0 THEN ' in tests' ELSE '' END)"


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """task_id, passage (text that its units hold), prompt (the passage, and the units that it names)."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("task_id"), F.col("text").alias("passage"), F.concat("text", F.expr(_MENTION.format("STRING"))).alias("prompt"))


TASKS = f"(SELECT item_id AS task_id, text AS passage, text || {_MENTION.format('VARCHAR')} AS prompt FROM benchmark)"


def unit_edges(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst, kind between units."""
    u, i = units(spark, folder).select("unit_id", "kind"), F.col("unit_id")
    kinds = [("IMPORTS", i % 3 == 0, i + 1), ("TESTS", F.col("kind") == "TEST", i - 2), ("CALLS", i % 5 == 0, i + 11)]
    rows = F.inline(F.array_compact(F.array(*[F.when(test, F.struct(i.alias("src"), dst.alias("dst"), F.lit(k).alias("kind"))) for k, test, dst in kinds])))
    return u.select(rows).join(u.select(i.alias("dst")), "dst", "left_semi").select("src", "dst", "kind")


UNIT_EDGES = f"""(SELECT src, dst, kind FROM (SELECT unit_id AS src, unit_id + 1 AS dst, 'IMPORTS' AS kind FROM {UNITS} WHERE unit_id % 3 = 0 UNION ALL SELECT unit_id, unit_id - 2, 'TESTS' FROM {UNITS} WHERE kind = 'TEST'
  UNION ALL SELECT unit_id, unit_id + 11, 'CALLS' FROM {UNITS} WHERE unit_id % 5 = 0) WHERE dst IN (SELECT doc_id FROM documents))"""

#: The time up to which the units' history is known.
UNIT_CUTOFF = "2024-02-15 00:00:00"
_EVENT_FILES = "(SELECT DISTINCT event_id // 40 AS sha, file FROM (SELECT event_id, user_id % 23 AS file FROM events UNION ALL SELECT event_id, 100 + event_id % 17 FROM events UNION ALL SELECT event_id, 1000 + event_id // 200 % 50 FROM events))"


def unit_commits(spark: SparkSession, folder: str) -> DataFrame:
    """sha, ts, file: forty events are a commit, which touches the paths of some units."""
    e = table(spark, folder, "events")
    file = F.explode(F.array(F.col("user_id") % 23, 100 + F.col("event_id") % 17, 1000 + F.expr("event_id div 200") % 50)).alias("unit_id")
    ts = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((F.col("sha") % 60).cast("int"))
    return e.select(F.expr("event_id div 40").alias("sha"), file).distinct().join(units(spark, folder).select("unit_id", F.col("path").alias("file")), "unit_id").select("sha", ts.alias("ts"), "file")


UNIT_COMMITS = f"(SELECT sha, TIMESTAMP '2024-01-01' + to_days(CAST(sha % 60 AS INT)) AS ts, path AS file FROM {_EVENT_FILES} JOIN {UNITS} ON unit_id = file)"


#: What a piece of evidence says, by its unit's number: an issue's title and body, a trace, or a message that alone names other files.
_TEXTS = {
    "title": "CASE WHEN {id} % 4 = 0 THEN concat('doc_', CAST({id} + 3 AS {text}), ' is wrong') END",
    "body": "CASE WHEN {id} % 8 = 0 THEN concat('see src/doc_', CAST({id} + 4 AS {text}), '.ts, or Doc_', CAST({id} AS {text}), '?') END",
    "trace": "CASE WHEN {id} % 3 = 0 THEN concat('Error: at doc_', CAST({id} + 5 AS {text}), '.ts:12 in (run)') END",
    "message": "CASE WHEN {id} % 3 <> 0 OR {id} % 4 = 0 THEN concat('doc_', CAST({id} + 6 AS {text}), '.md failed; DOC_', CAST({id} + 7 AS {text}), ' expected') END",
}


def _texts(id_: str, text: str) -> str:
    return ", ".join(f"{v.format(id=id_, text=text)} AS {k}" for k, v in _TEXTS.items())


def evidence(spark: SparkSession, folder: str) -> DataFrame:
    """task_id, kind, path, function, title, body, trace, message: errors stand for traces, failed tests and compiler errors in a unit's
    file, below another root."""
    e = table(spark, folder, "events").filter("event_type = 'error'").select((F.col("user_id") % 50).alias("task_id"), F.col("event_id").alias("unit_id"))
    rows = e.join(units(spark, folder).select("unit_id", "path"), "unit_id")
    kind = F.element_at(F.array(F.lit("STACK_TRACE"), F.lit("TEST_FAILURE"), F.lit("COMPILER_ERROR")), (F.col("unit_id") % 3 + 1).cast("int"))
    shown = rows.select("*", kind.alias("kind"), F.concat(F.lit("Doc_"), F.col("unit_id").cast("string")).alias("function"))
    return shown.selectExpr("task_id", "kind", "concat('/ci/', path) AS path", "function", *[f"{v.format(id='unit_id', text='STRING')} AS {k}" for k, v in _TEXTS.items()])


EVIDENCE = f"(SELECT user_id % 50 AS task_id, ['STACK_TRACE', 'TEST_FAILURE', 'COMPILER_ERROR'][CAST(event_id % 3 + 1 AS INT)] AS kind, '/ci/' || path AS path, 'Doc_' || event_id AS function, {_texts('event_id', 'VARCHAR')} FROM events JOIN {UNITS} ON unit_id = event_id WHERE event_type = 'error')"


def task_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("task_id"), (F.col("item_id") * 3).alias("unit_id"))


def dirty_paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("task_id"), F.concat(F.lit("doc_"), (F.col("item_id") * 3 + 2).cast("string"), F.lit(".")).alias("path"))


TASK_SEEDS = "(SELECT item_id AS task_id, item_id * 3 AS unit_id FROM benchmark)"
DIRTY = "(SELECT item_id AS task_id, 'doc_' || (item_id * 3 + 2) || '.' AS path FROM benchmark)"


def commit_files(spark: SparkSession, folder: str) -> DataFrame:
    """sha, ts, file: each file that a commit touches, once."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("file")).distinct()
    return lines.join(table(spark, folder, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts")), "sha")


COMMIT_FILES = "(SELECT DISTINCT l_orderkey AS sha, l_partkey AS file, o_orderdate AS ts FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """src, dst, kind: region -CONTAINS-> nation -CONTAINS-> customer, supplier; customer -CALLS-> order."""
    nation, customer, supplier, orders = (table(spark, folder, t) for t in ("nation", "customer", "supplier", "orders"))

    def edge(df: DataFrame, a: str, x: str, b: str, y: str, kind: str) -> DataFrame:
        return df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"), F.lit(kind).alias("kind"))

    return (
        edge(nation, "R", "n_regionkey", "N", "n_nationkey", "CONTAINS")
        .unionAll(edge(customer, "N", "c_nationkey", "C", "c_custkey", "CONTAINS"))
        .unionAll(edge(supplier, "S", "s_suppkey", "N", "s_nationkey", "DECLARED_IN"))
        .unionAll(edge(orders, "C", "o_custkey", "O", "o_orderkey", "CALLS"))
    )


EDGES = """(SELECT 'R' || n_regionkey AS src, 'N' || n_nationkey AS dst, 'CONTAINS' AS kind FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 'CONTAINS' FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'DECLARED_IN' FROM supplier
  UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey, 'CALLS' FROM orders)"""

#: Event types as trajectory events.
EVENT_TYPES = {"view": "FILE_READ", "click": "SEARCH", "purchase": "FILE_EDIT", "error": "TOOL_ERROR", "signup": "CONTEXT_SHOWN"}
_TYPE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TYPES.items()) + " ELSE 'OTHER' END"


def trajectory(spark: SparkSession, folder: str) -> DataFrame:
    """episode_id, event_id, ts, sequence, type, path, value."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("episode_id"), "event_id", "ts", F.row_number().over(order).alias("sequence"), F.expr(_TYPE).alias("type"), F.concat(F.lit("f"), (F.col("event_id") % 37).cast("string")).alias("path"), "value"
    )


TRAJECTORY = f"""(SELECT user_id AS episode_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence,
  {_TYPE} AS type, 'f' || (event_id % 37) AS path, value FROM events)"""


def episodes(spark: SparkSession, folder: str) -> DataFrame:
    """episode_id, repository_id, task_type, verified_success (tri-state), training_allowed, revoked, tokens: one for each document."""
    labels = table(spark, folder, "labels")
    return table(spark, folder, "documents").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("episode_id"),
        F.col("source").alias("repository_id"),
        F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("task_type"),
        F.when(F.col("quality") == 1, True).when(F.col("quality") == 0, False).alias("verified_success"),
        (F.col("doc_id") % 5 != 0).alias("training_allowed"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("revoked"),
        F.ceil(F.col("n_chars") / 4).cast("long").alias("tokens"),
    )


EPISODES = """(SELECT d.doc_id AS episode_id, source AS repository_id, CASE WHEN d.doc_id % 7 != 0 THEN lang END AS task_type,
  CASE quality WHEN 1 THEN true WHEN 0 THEN false END AS verified_success, d.doc_id % 5 != 0 AS training_allowed,
  coalesce(toxic = 1, false) AS revoked, CAST(ceil(n_chars / 4) AS BIGINT) AS tokens FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def exposures(spark: SparkSession, folder: str, *more: Column) -> DataFrame:
    """Candidate rows: episode_id, unit_id, line, rank, tokens, score, selected, shown, read, edited, task_succeeded (tri-state), kind.
    more: further columns of the line and its order."""
    return table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("l_orderkey").alias("episode_id"),
        F.col("l_partkey").alias("unit_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("long").alias("tokens"),
        F.col("l_extendedprice").alias("score"),
        (F.col("l_linestatus") == "F").alias("shown"),
        (F.col("l_returnflag") != "N").alias("read"),
        (F.col("l_returnflag") == "A").alias("edited"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("task_succeeded"),
        F.concat(F.lit("K"), (F.col("l_suppkey") % 4).cast("string")).alias("kind"),
        F.element_at(F.array(F.lit("FULL_TOOL_TRACE"), F.lit("OWN_CALLS_ONLY"), F.lit("HARNESS_NATIVE"), F.lit("PARTIAL_AGENT_TRACE")), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("observability"),
        *more,
    )


EXPOSURES = """(SELECT l_orderkey AS episode_id, l_partkey AS unit_id, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS tokens,
  l_extendedprice AS score, l_linestatus = 'F' AS shown, l_returnflag != 'N' AS "read", l_returnflag = 'A' AS edited,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS task_succeeded, 'K' || (l_suppkey % 4) AS kind,
  ['FULL_TOOL_TRACE', 'OWN_CALLS_ONLY', 'HARNESS_NATIVE', 'PARTIAL_AGENT_TRACE'][CAST(l_suppkey % 4 + 1 AS INT)] AS observability
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
