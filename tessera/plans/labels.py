"""Queries of labels, outcomes and exposures; order lines stand for candidates."""

from pyspark.sql import functions as F

from tessera.operators.labels import binary_label, confidence_bucket, dataset_label, edit_default, evidence_outcome, exposure_state, label_evidence, observation_label, read_default, relevance_grade, resolved_label, task_outcome
from tessera.registry import query
from tessera.sources.tables import EXPOSURES, TRAJECTORY, exposures, table, trajectory

_KEY = "episode_id, line"


def _rows(spark, folder):
    return exposures(spark, folder)


def c(name):
    return F.col(name)


@query(f"SELECT {_KEY}, CASE WHEN edited OR \"read\" OR unit_id % 9 = 0 THEN 'POSITIVE' WHEN shown THEN 'NEGATIVE' ELSE 'UNEXPOSED_UNKNOWN' END AS label FROM {EXPOSURES}")
def l01_observation_label(spark, folder):
    return _rows(spark, folder).select("episode_id", "line", observation_label(c("shown"), c("read"), c("edited"), c("unit_id") % 9 == 0).alias("label"))


_EV = "list_filter([CASE WHEN edited AND unit_id % 2 = 0 THEN 'EDITED' END, CASE WHEN \"read\" AND unit_id % 3 = 0 THEN 'READ' END, CASE WHEN unit_id % 17 = 0 THEN 'REQUESTED' END, CASE WHEN unit_id % 19 = 0 THEN 'FAILURE_TRACE' END, CASE WHEN unit_id % 23 = 0 THEN 'TEST_RELATED' END], lambda x: x IS NOT NULL)"
_LIM = "('OWN_CALLS_ONLY', 'PARTIAL_AGENT_TRACE')"
_FULL = "('FULL_TOOL_TRACE', 'HARNESS_NATIVE')"


@query(f"""SELECT {_KEY}, array_to_string(ev, ',') AS evidence, CASE WHEN len(ev) > 0 THEN 'POSITIVE' WHEN NOT shown THEN 'UNEXPOSED_UNKNOWN' WHEN observability IN {_LIM} THEN 'UNKNOWN'
  WHEN task_succeeded IS TRUE THEN 'WEAK_NEGATIVE' ELSE 'UNKNOWN' END AS label FROM (SELECT *, {_EV} AS ev FROM {EXPOSURES})""")
def l02_evidence_label(spark, folder):
    u = c("unit_id")
    ev = label_evidence({"EDITED": c("edited") & (u % 2 == 0), "READ": c("read") & (u % 3 == 0), "REQUESTED": u % 17 == 0, "FAILURE_TRACE": u % 19 == 0, "TEST_RELATED": u % 23 == 0})
    rows = _rows(spark, folder).withColumn("ev", ev)
    return rows.select("episode_id", "line", F.array_join(F.transform("ev", lambda x: x["label_type"]), ",").alias("evidence"), resolved_label(c("ev"), c("shown"), c("observability"), c("task_succeeded")).alias("label"))


@query(f"""SELECT {_KEY}, CASE WHEN unit_id % 31 = 0 OR (edited AND task_succeeded IS TRUE) OR ("read" AND task_succeeded IS TRUE) THEN 'POSITIVE'
   WHEN shown AND observability IN {_FULL} AND task_succeeded IS TRUE AND NOT "read" AND NOT edited THEN 'WEAK_NEGATIVE' ELSE 'UNKNOWN' END AS label_state,
  CASE WHEN unit_id % 31 = 0 THEN 0.98::DOUBLE WHEN edited AND task_succeeded IS TRUE THEN 0.95::DOUBLE WHEN "read" AND task_succeeded IS TRUE THEN 0.85::DOUBLE
   WHEN shown AND observability IN {_FULL} AND task_succeeded IS TRUE AND NOT "read" AND NOT edited THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM {EXPOSURES}""")
def l03_dataset_label(spark, folder):
    label = dataset_label(c("unit_id") % 31 == 0, c("shown"), c("observability"), c("read"), c("edited"), c("task_succeeded"))
    return _rows(spark, folder).select("episode_id", "line", label.alias("l")).select("episode_id", "line", "l.*")


@query(f"""SELECT {_KEY}, CASE WHEN shown AND observability NOT IN {_LIM} THEN false END AS read_default,
  CASE WHEN CASE WHEN shown THEN observability NOT IN {_LIM} ELSE observability IN {_FULL} END THEN false END AS edit_default FROM {EXPOSURES}""")
def l04_tri_state_defaults(spark, folder):
    return _rows(spark, folder).select("episode_id", "line", read_default(c("shown"), c("observability")).alias("read_default"), edit_default(c("shown"), c("observability")).alias("edit_default"))


_READ = "CASE WHEN unit_id % 4 > 0 THEN \"read\" END"


@query(f"""SELECT {_KEY}, o AS outcome_label, CASE o WHEN 'POSITIVE' THEN 1 WHEN 'WEAK_NEGATIVE' THEN 0 END AS label FROM (SELECT *,
  CASE WHEN edited OR (task_succeeded IS TRUE AND r IS TRUE) THEN 'POSITIVE' WHEN NOT shown THEN 'UNEXPOSED_UNKNOWN' WHEN observability IN {_LIM} OR r IS NULL THEN 'UNKNOWN'
   WHEN task_succeeded IS TRUE THEN 'WEAK_NEGATIVE' ELSE 'UNKNOWN' END AS o FROM (SELECT *, {_READ} AS r FROM {EXPOSURES}))""")
def l05_binary_label(spark, folder):
    read = F.when(c("unit_id") % 4 > 0, c("read"))
    return _rows(spark, folder).select("episode_id", "line", binary_label(c("edited"), read, c("task_succeeded"), c("shown"), c("observability")).alias("l")).select("episode_id", "line", "l.*")


@query(f"""SELECT {_KEY}, CASE WHEN edited AND task_succeeded IS TRUE THEN 4 WHEN edited THEN 3 WHEN r IS TRUE AND task_succeeded IS TRUE THEN 2 WHEN r IS TRUE THEN 1
  WHEN NOT shown OR observability IN {_LIM} OR r IS NULL THEN NULL WHEN task_succeeded IS TRUE THEN 0 END AS grade FROM (SELECT *, {_READ} AS r FROM {EXPOSURES})""")
def l06_relevance_grade(spark, folder):
    read = F.when(c("unit_id") % 4 > 0, c("read"))
    return _rows(spark, folder).select("episode_id", "line", relevance_grade(c("edited"), read, c("task_succeeded"), c("shown"), c("observability")).alias("grade"))


@query(f"""SELECT {_KEY}, CASE WHEN edited THEN 'EDITED' WHEN "read" THEN 'READ' WHEN shown THEN 'SHOWN' WHEN unit_id % 3 = 0 THEN 'MATERIALIZED' WHEN unit_id % 2 = 0 THEN 'SELECTED' ELSE 'CANDIDATE' END AS state FROM {EXPOSURES}""")
def l09_exposure_ladder(spark, folder):
    flags = {"SELECTED": c("unit_id") % 2 == 0, "MATERIALIZED": c("unit_id") % 3 == 0, "SHOWN": c("shown"), "READ": c("read"), "EDITED": c("edited")}
    return _rows(spark, folder).select("episode_id", "line", exposure_state(flags).alias("state"))


def _tri(column, n, at):
    return F.when(F.col(column) % n == at, True).when(F.col(column) % n == at + 1, False)


def _tri_sql(column, n, at):
    return f"CASE {column} % {n} WHEN {at} THEN true WHEN {at + 1} THEN false END"


_CHECKS = {"hidden_tests": (11, 2), "behavioral_oracle": (13, 4), "regression_tests": (5, 1), "security_checks": (17, 3), "build": (7, 2), "public_tests": (6, 1), "user_accepted": (4, 1), "agent_reported": (3, 0), "task_verifier": (9, 3), "typecheck": (8, 5), "targeted_tests": (10, 6)}
_EVIDENCE = "(SELECT o_orderkey AS task_id, CASE o_orderkey % 29 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 2 THEN 'UNKNOWN' END AS human_review, " + ", ".join(f"{_tri_sql('o_orderkey', *v)} AS {k}" for k, v in _CHECKS.items()) + " FROM orders)"


def _checks(spark, folder):
    k = F.col("o_orderkey") % 29
    review = F.when(k == 0, "PASS").when(k == 1, "FAIL").when(k == 2, "UNKNOWN")
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("task_id"), review.alias("human_review"), *[_tri("o_orderkey", *v).alias(name) for name, v in _CHECKS.items()])


_SOUND = "regression_tests IS NOT FALSE AND security_checks IS NOT FALSE"
_OUTCOME = f"""(SELECT task_id, CASE WHEN human_review = 'PASS' THEN true WHEN human_review = 'FAIL' THEN false WHEN hidden_tests AND {_SOUND} THEN true WHEN behavioral_oracle AND {_SOUND} THEN true
  WHEN hidden_tests IS FALSE OR behavioral_oracle IS FALSE THEN false END AS verified_success,
  (CASE WHEN human_review IN ('PASS', 'FAIL') THEN 1.0 WHEN hidden_tests AND {_SOUND} THEN 0.98 WHEN behavioral_oracle AND {_SOUND} THEN 0.95 WHEN hidden_tests IS FALSE OR behavioral_oracle IS FALSE THEN 0.98
  WHEN regression_tests IS FALSE THEN 0.5 WHEN build IS FALSE THEN 0.4 WHEN public_tests IS FALSE THEN 0.5 WHEN public_tests IS TRUE THEN 0.6 WHEN build IS TRUE THEN 0.4
  WHEN user_accepted IS NOT NULL THEN 0.5 WHEN agent_reported IS NOT NULL THEN 0.35 ELSE 0.1 END)::DOUBLE AS confidence FROM {_EVIDENCE})"""


@query(f"SELECT * FROM {_OUTCOME}")
def l10_evidence_outcome(spark, folder):
    return _checks(spark, folder).select("task_id", evidence_outcome().alias("o")).select("task_id", "o.*")


@query(f"""SELECT task_id, CASE WHEN human_review = 'PASS' THEN true WHEN human_review = 'FAIL' THEN false WHEN task_verifier IS TRUE THEN regression_tests IS NOT FALSE WHEN task_verifier IS FALSE THEN false
  WHEN build IS FALSE OR typecheck IS FALSE THEN false WHEN targeted_tests IS TRUE THEN regression_tests IS NOT FALSE WHEN targeted_tests IS FALSE THEN false END AS verified_success,
  CASE WHEN human_review IN ('PASS', 'FAIL') OR task_verifier IS NOT NULL OR build IS FALSE OR typecheck IS FALSE THEN 'HIGH' WHEN targeted_tests IS TRUE AND regression_tests IS FALSE THEN 'HIGH'
  WHEN targeted_tests IS NOT NULL THEN 'MEDIUM' ELSE 'UNKNOWN' END AS confidence FROM {_EVIDENCE}""")
def l11_task_outcome(spark, folder):
    return _checks(spark, folder).select("task_id", task_outcome().alias("o")).select("task_id", "o.*")


@query(f"SELECT task_id, CASE WHEN confidence >= 0.9 THEN 'HIGH' WHEN confidence >= 0.7 THEN 'MEDIUM' WHEN confidence > 0.3 THEN 'LOW' ELSE 'UNKNOWN' END AS bucket FROM {_OUTCOME}")
def l12_confidence_bucket(spark, folder):
    return _checks(spark, folder).select("task_id", confidence_bucket(evidence_outcome()["confidence"]).alias("bucket"))


@query(f"""SELECT d.l_orderkey AS episode_id, d.l_linenumber AS line, b.n AS reads, o.o_orderstatus AS outcome FROM lineitem d
  LEFT JOIN (SELECT episode_id, path, count(*) AS n FROM {TRAJECTORY} WHERE type = 'FILE_READ' GROUP BY ALL) b ON b.episode_id = d.l_orderkey AND b.path = 'f' || (d.l_partkey % 37)
  LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON o.o_orderkey = d.l_orderkey""")
def j14_decision_behaviour_outcome(spark, folder):
    d = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("line"), F.concat(F.lit("f"), (F.col("l_partkey") % 37).cast("string")).alias("path"))
    b = trajectory(spark, folder).filter("type = 'FILE_READ'").groupBy("episode_id", "path").agg(F.count(F.lit(1)).alias("reads"))
    o = table(spark, folder, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("episode_id"), F.col("o_orderstatus").alias("outcome"))
    return d.join(b, ["episode_id", "path"], "left").join(o, "episode_id", "left").select("episode_id", "line", "reads", "outcome")


@query("SELECT count(*) AS candidates, count(*) FILTER (WHERE o_orderkey IS NULL) AS unmatched FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 100 > 0")
def j15_mandatory_exposure(spark, folder):
    e = table(spark, folder, "orders").filter("o_orderkey % 100 > 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("hit"))
    return table(spark, folder, "lineitem").join(e, "l_orderkey", "left").agg(F.count(F.lit(1)).alias("candidates"), F.count(F.when(F.col("hit").isNull(), 1)).alias("unmatched"))


@query(f"""WITH r AS (SELECT DISTINCT episode_id, event_id % 5 AS unit, path FROM {TRAJECTORY} WHERE type = 'FILE_READ')
  SELECT x.episode_id, x.line, CASE WHEN a.episode_id IS NOT NULL THEN 'EXACT_UNIT' WHEN b.episode_id IS NOT NULL THEN 'PATH_LEVEL' ELSE 'NONE' END AS attribution
  FROM {EXPOSURES} x LEFT JOIN (SELECT DISTINCT episode_id, unit FROM r) a ON a.episode_id = x.episode_id AND a.unit = x.unit_id
  LEFT JOIN (SELECT DISTINCT episode_id, path FROM r) b ON b.episode_id = x.episode_id AND b.path = 'f' || (x.unit_id % 37)""")
def j16_exposure_attribution(spark, folder):
    reads = trajectory(spark, folder).filter("type = 'FILE_READ'")
    exact = reads.select("episode_id", (F.col("event_id") % 5).alias("unit_id"), F.lit(True).alias("exact")).distinct()
    path = reads.select("episode_id", "path", F.lit(True).alias("by_path")).distinct()
    x = exposures(spark, folder).withColumn("path", F.concat(F.lit("f"), (F.col("unit_id") % 37).cast("string")))
    how = F.when(F.col("exact"), "EXACT_UNIT").when(F.col("by_path"), "PATH_LEVEL").otherwise("NONE")
    return x.join(exact, ["episode_id", "unit_id"], "left").join(path, ["episode_id", "path"], "left").select("episode_id", "line", how.alias("attribution"))


@query(f"""SELECT episode_id, count(*) AS events, count(*) FILTER (WHERE type = 'FILE_READ') AS reads, count(*) FILTER (WHERE type = 'FILE_EDIT') AS edits, count(*) FILTER (WHERE type = 'SEARCH') AS searches,
  count(DISTINCT path) FILTER (WHERE type = 'FILE_READ') AS paths_read, count(DISTINCT path) FILTER (WHERE type = 'FILE_EDIT') AS paths_edited,
  CASE WHEN count(*) >= 2 THEN epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 END AS duration_ms FROM {TRAJECTORY} GROUP BY episode_id""")
def a13_trajectory_summary(spark, folder):
    of = lambda t: F.col("type") == t
    return trajectory(spark, folder).groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(of("FILE_READ")).alias("reads"), F.count_if(of("FILE_EDIT")).alias("edits"), F.count_if(of("SEARCH")).alias("searches"),
        F.count_distinct(F.when(of("FILE_READ"), F.col("path"))).alias("paths_read"), F.count_distinct(F.when(of("FILE_EDIT"), F.col("path"))).alias("paths_edited"),
        F.when(F.count(F.lit(1)) >= 2, F.unix_millis(F.max("ts").cast("timestamp")) - F.unix_millis(F.min("ts").cast("timestamp"))).alias("duration_ms"),
    )


@query("""SELECT conv_id AS session_id, count(*) AS calls, count(*) FILTER (WHERE role = 'assistant') AS errors, round(count(*) FILTER (WHERE role = 'assistant') / count(*), 4) AS error_rate,
  sum(length(text))::BIGINT AS duration, count(DISTINCT left(text, 3)) AS files FROM conversations GROUP BY conv_id""")
def a14_tool_trace(spark, folder):
    n, bad = F.count(F.lit(1)), F.count_if(F.col("role") == "assistant")
    return table(spark, folder, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(n.alias("calls"), bad.alias("errors"), F.round(bad / n, 4).alias("error_rate"), F.sum(F.length("text")).cast("long").alias("duration"), F.count_distinct(F.left("text", F.lit(3))).alias("files"))


@query(f"SELECT episode_id, event_id, sequence, type FROM {TRAJECTORY}")
def w10_event_sequence(spark, folder):
    return trajectory(spark, folder).select("episode_id", "event_id", "sequence", "type")


@query(f"""SELECT e.episode_id, coalesce(x.n, 0) AS exposures, coalesce(x.edited, 0) AS edited, coalesce(t.n, 0) AS events, o.verified_success
  FROM (SELECT o_orderkey AS episode_id FROM orders) e LEFT JOIN (SELECT episode_id, count(*) AS n, count(*) FILTER (WHERE edited) AS edited FROM {EXPOSURES} GROUP BY ALL) x ON x.episode_id = e.episode_id
  LEFT JOIN (SELECT episode_id, count(*) AS n FROM {TRAJECTORY} GROUP BY ALL) t ON t.episode_id = e.episode_id LEFT JOIN {_OUTCOME} o ON o.task_id = e.episode_id""")
def l15_episode_assembly(spark, folder):
    e = table(spark, folder, "orders").select(F.col("o_orderkey").alias("episode_id"))
    x = exposures(spark, folder).groupBy("episode_id").agg(F.count(F.lit(1)).alias("exposures"), F.count_if("edited").alias("edited"))
    t = trajectory(spark, folder).groupBy("episode_id").agg(F.count(F.lit(1)).alias("events"))
    o = _checks(spark, folder).select(F.col("task_id").alias("episode_id"), evidence_outcome()["verified_success"].alias("verified_success"))
    return e.join(x, "episode_id", "left").join(t, "episode_id", "left").join(o, "episode_id", "left").select("episode_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("exposures", "edited", "events")], "verified_success")
