"""Queries of history; orders stand for commits, parts for files."""

from pyspark.sql import functions as F

from tessera.operators.history import change_frequency, co_change_scores, co_changes, directional_co_change, epoch_to_timestamp, expand_by_co_change, latest_commits, until
from tessera.registry import query
from tessera.sources.tables import COMMIT_FILES, UNIT_COMMITS, UNIT_CUTOFF, UNITS, commit_files, table, unit_commits, units

CUTOFF = "1997-06-01 00:00:00"
_AT = f"TIMESTAMP '{CUTOFF}'"
_KNOWN = f"(SELECT * FROM {COMMIT_FILES} WHERE ts <= {_AT})"
_SHARED = f"(SELECT a.file AS file, b.file AS other, count(*) AS shared FROM {_KNOWN} a JOIN {_KNOWN} b ON a.sha = b.sha AND a.file <> b.file GROUP BY ALL)"
_SCORES = f"(SELECT file, other, shared, shared / total AS score FROM {_SHARED} JOIN (SELECT file, count(*) AS total FROM {_KNOWN} GROUP BY file) USING (file))"


@query(f"SELECT o_orderkey AS sha, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate <= {_AT} ORDER BY o_orderdate DESC, o_orderkey LIMIT 500")
def s10_latest_commits(spark, folder):
    commits = table(spark, folder, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ts"))
    return latest_commits(commits, CUTOFF).select("sha", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00'")
def p04_point_in_time(spark, folder):
    return until(table(spark, folder, "events"), "2024-01-15 00:00:00").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


@query("SELECT event_id, CASE WHEN n < 10000000000 THEN n * 1000 ELSE n END AS ms FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) // 1000000 ELSE epoch_us(ts) // 1000 END AS n FROM events)")
def p04_epoch_coercion(spark, folder):
    n = F.when(F.col("event_id") % 2 == 0, F.expr("unix_millis(cast(ts as timestamp)) div 1000")).otherwise(F.unix_millis(F.col("ts").cast("timestamp")))
    return table(spark, folder, "events").select("event_id", F.unix_millis(epoch_to_timestamp(n).cast("timestamp")).alias("ms"))


@query(f"SELECT * FROM {_SHARED} WHERE shared >= 2")
def j12_co_change_pairs(spark, folder):
    return co_changes(until(commit_files(spark, folder), CUTOFF), 2)


@query(f"""WITH t AS (SELECT * FROM {UNIT_COMMITS} WHERE ts <= TIMESTAMP '{UNIT_CUTOFF}'), n AS (SELECT file, count(*) AS total FROM t GROUP BY file), s AS (SELECT a.file AS file, b.file AS other, count(*) AS shared FROM t a JOIN t b ON a.sha = b.sha AND a.file <> b.file GROUP BY ALL)
  SELECT file, other, shared, round(shared / total, 6) AS score FROM s JOIN n USING (file) WHERE shared >= 3 AND shared / total >= 0.15""")
def a10_co_change_scores(spark, folder):
    return co_change_scores(unit_commits(spark, folder), UNIT_CUTOFF).select("file", "other", "shared", F.round("score", 6).alias("score"))


_PAIRS = "(SELECT p_partkey AS a, p_partkey % 11 * 7 + 1 AS b FROM part UNION SELECT p_partkey, p_partkey FROM part WHERE p_partkey % 9 = 0 UNION SELECT -p_partkey, p_partkey FROM part WHERE p_partkey < 5)"


@query(f"""SELECT a, b, round(CASE WHEN a = b THEN 1 WHEN t.total IS NULL THEN 0 ELSE coalesce(n, 0) / total END, 6) AS score FROM {_PAIRS} p
  LEFT JOIN (SELECT file, count(*) AS total FROM {_KNOWN} GROUP BY file) t ON t.file = a
  LEFT JOIN (SELECT x.file AS xf, y.file AS yf, count(*) AS n FROM {_KNOWN} x JOIN {_KNOWN} y ON x.sha = y.sha GROUP BY ALL) s ON xf = a AND yf = b""")
def a11_directional_co_change(spark, folder):
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("k"))
    pairs = part.select(F.col("k").alias("a"), (F.col("k") % 11 * 7 + 1).alias("b"))
    pairs = pairs.union(part.filter("k % 9 = 0").select("k", "k")).union(part.filter("k < 5").select(-F.col("k"), "k")).distinct()
    return directional_co_change(commit_files(spark, folder), pairs, CUTOFF).withColumn("score", F.round("score", 6))


@query(f"SELECT file, count(DISTINCT sha) AS changes, count(DISTINCT sha) FILTER (WHERE ts >= {_AT} - INTERVAL 30 DAYS) AS recent_changes FROM {_KNOWN} GROUP BY file")
def a12_change_frequency(spark, folder):
    return change_frequency(commit_files(spark, folder), CUTOFF)


@query(f"SELECT o_orderkey AS sha, o_custkey AS author FROM orders WHERE o_orderdate BETWEEN {_AT} - INTERVAL 30 DAYS AND {_AT}")
def t05_trailing_window(spark, folder):
    at = F.lit(CUTOFF).cast("timestamp")
    return table(spark, folder, "orders").filter(F.col("o_orderdate").between(at - F.expr("INTERVAL 30 DAYS"), at)).select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("author"))


@query(f"""WITH hist AS (SELECT sha, file FROM {UNIT_COMMITS} WHERE ts <= TIMESTAMP '{UNIT_CUTOFF}'), co AS (SELECT a.file AS file, b.file AS other, count(*) / any_value(n.total) AS score FROM hist a JOIN hist b ON a.sha = b.sha AND a.file <> b.file
  JOIN (SELECT file, count(*) AS total FROM hist GROUP BY file) n ON n.file = a.file GROUP BY ALL HAVING count(*) >= 3 AND count(*) / any_value(n.total) >= 0.15)
  SELECT task_id, other AS unit_id, round(max(score), 6) AS co_change_score FROM (SELECT item_id % 50 AS task_id, path AS file FROM benchmark JOIN {UNITS} ON unit_id % 97 = item_id % 97) JOIN co USING (file) GROUP BY ALL""")
def j13_co_change_expansion(spark, folder):
    """Partners of each task's seed files, with the least commits and the least share that count."""
    items = table(spark, folder, "benchmark").select((F.col("item_id") % 50).alias("task_id"), (F.col("item_id") % 97).alias("k"))
    seeds = items.join(units(spark, folder).select((F.col("unit_id") % 97).alias("k"), F.col("path").alias("file")), "k").select("task_id", "file").distinct()
    return expand_by_co_change(seeds, co_change_scores(unit_commits(spark, folder), UNIT_CUTOFF)).withColumn("co_change_score", F.round("co_change_score", 6))


@query("SELECT DISTINCT o_custkey AS repository, o_orderdate::DATE::VARCHAR AS commit FROM orders")
def u05_distinct_pairs(spark, folder):
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("repository"), F.to_date("o_orderdate").cast("string").alias("commit")).dropDuplicates()
