"""Queries of the flywheel: summaries, signals, quality and readiness."""

from pyspark.sql import functions as F

from tessera.registry import query
from tessera.sources.tables import EPISODES, EXPOSURES, TRAJECTORY, UNITS, episodes, exposures, table, trajectory, units


def c(name):
    return F.col(name)


def rate(part, whole, places=3):
    return F.when(whole > 0, F.round(part / whole, places)).otherwise(0.0)


def _rate(part, whole, places=3):
    return f"CASE WHEN {whole} > 0 THEN round({part} / {whole}, {places}) ELSE 0 END"


@query(f"""SELECT count(*) AS total, count(verified_success) AS verified, count(*) FILTER (WHERE verified_success) AS success, count(*) FILTER (WHERE NOT verified_success) AS failed,
  count(*) FILTER (WHERE verified_success IS NULL) AS unknown, count(*) FILTER (WHERE NOT training_allowed) AS rights_blocked FROM {EPISODES} WHERE NOT revoked""")
def a01_flywheel_summary(spark, folder):
    e = episodes(spark, folder)
    live = e.join(e.filter("revoked").select("episode_id"), "episode_id", "left_anti")
    v = c("verified_success")
    return live.agg(F.count(F.lit(1)).alias("total"), F.count(v).alias("verified"), F.count_if(v).alias("success"), F.count_if(~v).alias("failed"), F.count_if(v.isNull()).alias("unknown"), F.count_if(~c("training_allowed")).alias("rights_blocked"))


@query(f"SELECT 'repository' AS by, repository_id AS value, count(*) AS n FROM {EPISODES} GROUP BY ALL UNION ALL SELECT 'task_type', coalesce(task_type, 'OTHER'), count(*) FROM {EPISODES} GROUP BY ALL UNION ALL SELECT 'state', CASE WHEN edited THEN 'EDITED' WHEN \"read\" THEN 'READ' ELSE 'OTHER' END, count(*) FROM {EXPOSURES} GROUP BY ALL")
def a02_group_counts(spark, folder):
    def count(df, by, value):
        return df.groupBy(F.lit(by).alias("by"), value.alias("value")).agg(F.count(F.lit(1)).alias("n"))

    e = episodes(spark, folder)
    state = F.when(c("edited"), "EDITED").when(c("read"), "READ").otherwise("OTHER")
    return count(e, "repository", c("repository_id")).unionAll(count(e, "task_type", F.coalesce("task_type", F.lit("OTHER")))).unionAll(count(exposures(spark, folder), "state", state))


@query("SELECT count(DISTINCT user_id) AS episodes, count(DISTINCT event_type) AS types FROM events")
def a03_distinct_counts(spark, folder):
    return table(spark, folder, "events").agg(F.count_distinct("user_id").alias("episodes"), F.count_distinct("event_type").alias("types"))


@query(f"""SELECT {_rate('count(verified_success)', 'count(*)')} AS verified_rate, {_rate('count(*) FILTER (WHERE verified_success IS NULL)', 'count(*)')} AS unknown_rate,
  {_rate('count(*) FILTER (WHERE training_allowed)', 'count(*)')} AS permission_rate, {_rate('count(*) FILTER (WHERE t.e IS NOT NULL)', 'count(*)')} AS trajectory_rate
  FROM {EPISODES} LEFT JOIN (SELECT DISTINCT user_id AS e FROM events) t ON t.e = episode_id WHERE NOT revoked""")
def a04_data_quality(spark, folder):
    t = table(spark, folder, "events").select(c("user_id").alias("episode_id"), F.lit(True).alias("hit")).distinct()
    rows, n = episodes(spark, folder).filter(~c("revoked")).join(t, "episode_id", "left"), F.count(F.lit(1))
    v = c("verified_success")
    return rows.agg(rate(F.count(v), n).alias("verified_rate"), rate(F.count_if(v.isNull()), n).alias("unknown_rate"), rate(F.count_if(c("training_allowed")), n).alias("permission_rate"), rate(F.count("hit"), n).alias("trajectory_rate"))


_X = f"(SELECT x.*, coalesce(e.task_type, 'OTHER') AS task_type, e.repository_id FROM {EXPOSURES} x JOIN {EPISODES} e USING (episode_id))"


def _typed(spark, folder):
    e = episodes(spark, folder).select("episode_id", F.coalesce("task_type", F.lit("OTHER")).alias("task_type"), "repository_id")
    return exposures(spark, folder).join(e, "episode_id")


@query(f"""SELECT task_type, kind AS unit_kind, s AS shown_count, r AS read_count, d AS edited_count, {_rate('r', 's')} AS read_rate, {_rate('d', 'r')} AS edit_rate FROM
  (SELECT task_type, kind, count(*) FILTER (WHERE shown) AS s, count(*) FILTER (WHERE "read") AS r, count(*) FILTER (WHERE edited) AS d FROM {_X} GROUP BY ALL)""")
def a05_usefulness(spark, folder):
    g = _typed(spark, folder).groupBy("task_type", c("kind").alias("unit_kind")).agg(F.count_if("shown").alias("shown_count"), F.count_if("read").alias("read_count"), F.count_if("edited").alias("edited_count"))
    return g.withColumns({"read_rate": rate(c("read_count"), c("shown_count")), "edit_rate": rate(c("edited_count"), c("read_count"))})


_SOURCES = "list_filter([CASE WHEN unit_id % 2 = 0 THEN 'lexical' END, CASE WHEN unit_id % 3 = 0 THEN 'graph' END, CASE WHEN unit_id % 5 = 0 THEN 'exact' END], lambda x: x IS NOT NULL)"


@query(f"SELECT repository_id, source, count(*) AS candidates, count(*) FILTER (WHERE shown) AS selected, {_rate('count(*) FILTER (WHERE shown)', 'count(*)')} AS selection_rate FROM (SELECT repository_id, shown, unnest({_SOURCES}) AS source FROM {_X}) GROUP BY ALL")
def a06_selection_rate(spark, folder):
    u = c("unit_id")
    sources = F.array_compact(F.array(F.when(u % 2 == 0, "lexical"), F.when(u % 3 == 0, "graph"), F.when(u % 5 == 0, "exact")))
    rows, n, s = _typed(spark, folder).select("repository_id", "shown", F.explode(sources).alias("source")), F.count(F.lit(1)), F.count_if("shown")
    return rows.groupBy("repository_id", "source").agg(n.alias("candidates"), s.alias("selected"), rate(s, n).alias("selection_rate"))


@query(f"""SELECT b.bucket, count(x.episode_id) AS candidates, count(*) FILTER (WHERE "read") AS read_count, {_rate('count(*) FILTER (WHERE "read")', 'count(x.episode_id)')} AS read_probability
  FROM (VALUES ('1-3'), ('4-10'), ('11-25'), ('26+')) b(bucket) LEFT JOIN (SELECT *, CASE WHEN line <= 3 THEN '1-3' WHEN line <= 10 THEN '4-10' WHEN line <= 25 THEN '11-25' ELSE '26+' END AS bucket FROM {EXPOSURES}) x USING (bucket) GROUP BY ALL""")
def a07_rank_calibration(spark, folder):
    buckets = spark.range(1).select(F.explode(F.array(*map(F.lit, ("1-3", "4-10", "11-25", "26+")))).alias("bucket"))
    bucket = F.when(c("line") <= 3, "1-3").when(c("line") <= 10, "4-10").when(c("line") <= 25, "11-25").otherwise("26+")
    g = exposures(spark, folder).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if("read").alias("r"))
    n, r = F.coalesce("n", F.lit(0)), F.coalesce("r", F.lit(0))
    return buckets.join(g, "bucket", "left").select("bucket", n.alias("candidates"), r.alias("read_count"), rate(r, n).alias("read_probability"))


@query(f"""SELECT kind AS unit_kind, s AS in_success, f AS in_failure, CASE WHEN f > 0 THEN round(s / f, 2) WHEN s > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS relative_advantage FROM
  (SELECT kind, count(*) FILTER (WHERE task_succeeded) AS s, count(*) FILTER (WHERE NOT task_succeeded) AS f FROM {EXPOSURES} WHERE shown GROUP BY ALL)""")
def a08_success_exposure(spark, folder):
    g = exposures(spark, folder).filter("shown").groupBy(c("kind").alias("unit_kind")).agg(F.count_if("task_succeeded").alias("in_success"), F.count_if(~c("task_succeeded")).alias("in_failure"))
    s, f = c("in_success"), c("in_failure")
    return g.withColumn("relative_advantage", F.when(f > 0, F.round(s / f, 2)).when(s > 0, 1.0).otherwise(0.0))


@query(f"SELECT {_rate('r', 's')} AS read_after_show, {_rate('d', 'r')} AS edit_after_read FROM (SELECT count(*) FILTER (WHERE shown) AS s, count(*) FILTER (WHERE \"read\") AS r, count(*) FILTER (WHERE edited) AS d FROM {EXPOSURES})")
def a09_global_rates(spark, folder):
    s, r, d = (F.count_if(x) for x in ("shown", "read", "edited"))
    return exposures(spark, folder).agg(rate(r, s).alias("read_after_show"), rate(d, r).alias("edit_after_read"))


@query("SELECT CASE WHEN o_orderkey % 20 < 12 THEN 'train' WHEN o_orderkey % 20 < 15 THEN 'validation' ELSE 'test' END AS split, count(*) AS rows, count(*) FILTER (WHERE l_returnflag <> 'N') AS positive, count(DISTINCT o_orderkey) AS episodes FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def a15_dataset_summary(spark, folder):
    k = c("l_orderkey") % 20
    split = F.when(k < 12, "train").when(k < 15, "validation").otherwise("test")
    return table(spark, folder, "lineitem").groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(c("l_returnflag") != "N").alias("positive"), F.count_distinct("l_orderkey").alias("episodes"))


@query(f"SELECT repository_id, count(*) FILTER (WHERE shown) AS shown, count(*) FILTER (WHERE \"read\") AS \"read\", count(*) FILTER (WHERE edited) AS edited, count(*) FILTER (WHERE task_succeeded) AS success, count(*) FILTER (WHERE task_succeeded IS NULL) AS unknown FROM {_X} GROUP BY ALL")
def a16_dataset_outcomes(spark, folder):
    return _typed(spark, folder).groupBy("repository_id").agg(*[F.count_if(x).alias(x) for x in ("shown", "read", "edited")], F.count_if("task_succeeded").alias("success"), F.count_if(c("task_succeeded").isNull()).alias("unknown"))


@query("SELECT round(sum(cost) / count(*) FILTER (WHERE ok), 4) AS cost_per_success, count(*) FILTER (WHERE ok) AS successes, CASE WHEN count(*) FILTER (WHERE none) > 0 THEN 1.0 END AS none FROM (SELECT o_totalprice / 1000 AS cost, o_orderstatus = 'F' AS ok, false AS none FROM orders)")
def a21_cost_per_success(spark, folder):
    ok = c("o_orderstatus") == "F"
    n = F.count_if(ok)
    return table(spark, folder, "orders").agg(F.when(n > 0, F.round(F.sum(c("o_totalprice") / 1000) / n, 4)).alias("cost_per_success"), n.alias("successes"), F.lit(None).cast("double").alias("none"))


@query("SELECT key, count(*) AS n FROM (SELECT 'BASELINE:' || l_returnflag AS key FROM lineitem UNION ALL SELECT 'CANDIDATE:' || l_linestatus FROM lineitem) GROUP BY ALL")
def a22_validity_histogram(spark, folder):
    arms = F.explode(F.array(F.concat(F.lit("BASELINE:"), c("l_returnflag")), F.concat(F.lit("CANDIDATE:"), c("l_linestatus"))))
    return table(spark, folder, "lineitem").select(arms.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT unit_id, path, tokens AS raw_tokens, tokens // 4 AS skeleton_tokens FROM {UNITS} WHERE tokens > 500 ORDER BY tokens - tokens // 4 DESC, unit_id LIMIT 10""")
def k06_top_bloat(spark, folder):
    small = F.expr("tokens div 4")
    u = units(spark, folder).select("unit_id", "path", c("tokens").alias("raw_tokens"), small.alias("skeleton_tokens")).filter("raw_tokens > 500")
    return u.orderBy((c("raw_tokens") - c("skeleton_tokens")).desc(), "unit_id").limit(10)


@query(f"""SELECT repository_id, sum(tokens)::BIGINT AS raw_tokens, sum(tokens // 4)::BIGINT AS skeleton_tokens, {_rate('100 * (sum(tokens) - sum(tokens // 4))', 'sum(tokens)', 1)} AS saving_percent,
  round(least(sum(tokens) - sum(tokens // 4), 150000) * 160 * 3.0 / 1000000, 2)::DOUBLE AS monthly_cost FROM {UNITS} GROUP BY ALL""")
def a25_token_audit(spark, folder):
    g = units(spark, folder).groupBy("repository_id").agg(F.sum("tokens").alias("raw_tokens"), F.sum(F.expr("tokens div 4")).alias("skeleton_tokens"))
    saved = c("raw_tokens") - c("skeleton_tokens")
    return g.withColumns({"saving_percent": rate(100 * saved, c("raw_tokens"), 1), "monthly_cost": F.round(F.least(saved, F.lit(150_000)) * 160 * 3.0 / 1_000_000, 2)})


@query("SELECT conv_id AS session_id, count(*) AS plans, count(*) FILTER (WHERE role = 'user') AS outcomes, sum(CASE WHEN turn % 3 = 0 THEN length(text) WHEN turn % 3 = 1 THEN 10 ELSE 0 END)::BIGINT AS tokens FROM conversations GROUP BY ALL")
def a26_session_status(spark, folder):
    actual, rendered = F.when(c("turn") % 3 == 0, F.length("text")), F.when(c("turn") % 3 == 1, 10)
    return table(spark, folder, "conversations").groupBy(c("conv_id").alias("session_id")).agg(F.count(F.lit(1)).alias("plans"), F.count_if(c("role") == "user").alias("outcomes"), F.sum(F.coalesce(actual, rendered, F.lit(0))).cast("long").alias("tokens"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS sessions, round(sum(value) * 3.0 / 1000000, 6) AS dollars FROM events GROUP BY ALL")
def a27_event_counters(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("sessions"), F.round(F.sum("value") * 3.0 / 1_000_000, 6).alias("dollars"))


_POPULATION = f"""(SELECT count(*) AS episodes, count(*) FILTER (WHERE verified_success) AS successes, count(*) FILTER (WHERE NOT verified_success) AS failures, count(*) FILTER (WHERE verified_success IS NULL) AS unknown,
  count(*) FILTER (WHERE x.e IS NOT NULL) AS logged, count(*) FILTER (WHERE NOT training_allowed) AS unpermitted,
  (SELECT count(DISTINCT l_orderkey) FROM lineitem JOIN labels ON doc_id = l_orderkey WHERE toxic = 1) AS revoked, count(*) FILTER (WHERE verified_success IS NOT NULL AND p.e IS NULL) AS unproven,
  (SELECT count(DISTINCT user_id) FROM events) AS audited, (SELECT count(*) FROM events WHERE value < 0) AS leaks, (SELECT count(*) FROM conversations) AS shadow_runs,
  (SELECT count(DISTINCT conv_id) FROM conversations JOIN events ON event_id = conv_id WHERE event_type = 'error') AS crashes
  FROM {EPISODES} LEFT JOIN (SELECT DISTINCT l_orderkey AS e FROM lineitem) x ON x.e = episode_id LEFT JOIN (SELECT o_orderkey AS e FROM orders WHERE o_orderstatus <> 'P') p ON p.e = episode_id WHERE NOT revoked)"""


def population(spark, folder):
    """One row: what the readiness gates ask for. Orders that are settled stand for proofs, lines of revoked episodes for violations of the
    training pool, errors with a conversation's id for crashed shadow runs."""
    proven = table(spark, folder, "orders").filter("o_orderstatus <> 'P'").select(c("o_orderkey").alias("episode_id"), F.lit(True).alias("proven"))
    logged = table(spark, folder, "lineitem").select(c("l_orderkey").alias("episode_id"), F.lit(True).alias("logged")).distinct()
    v = c("verified_success")
    main = episodes(spark, folder).filter(~c("revoked")).join(logged, "episode_id", "left").join(proven, "episode_id", "left").agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(v).alias("successes"), F.count_if(~v).alias("failures"), F.count_if(v.isNull()).alias("unknown"), F.count("logged").alias("logged"),
        F.count_if(~c("training_allowed")).alias("unpermitted"), F.count_if(v.isNotNull() & c("proven").isNull()).alias("unproven"),
    )
    events = table(spark, folder, "events").agg(F.count_distinct("user_id").alias("audited"), F.count_if(c("value") < 0).alias("leaks"))
    shadow = table(spark, folder, "conversations").agg(F.count(F.lit(1)).alias("shadow_runs"))
    toxic = table(spark, folder, "labels").filter("toxic = 1").select(c("doc_id").alias("episode_id"))
    pool = logged.join(toxic, "episode_id", "left_semi").agg(F.count(F.lit(1)).alias("revoked"))
    failed = table(spark, folder, "events").filter("event_type = 'error'").select(c("event_id").alias("conv_id"))
    crashed = table(spark, folder, "conversations").join(failed, "conv_id", "left_semi").agg(F.count_distinct("conv_id").alias("crashes"))
    return main.crossJoin(events).crossJoin(shadow).crossJoin(pool).crossJoin(crashed)  # one row each


@query(f"SELECT * FROM {_POPULATION}")
def a29_readiness_population(spark, folder):
    return population(spark, folder)


_COVER = "(CASE WHEN episodes > 0 THEN round(logged / episodes, 3) ELSE 0 END)"
_GATES = {
    "total_episodes": "episodes >= 1000",
    "verified_outcomes": "successes >= 200 AND failures >= 100",
    "candidate_logging": f"episodes > 0 AND {_COVER} >= 0.8",
    "rights_clearance": "episodes > 0 AND unpermitted + revoked = 0",
    "supervision_diversity": "successes > 0 AND failures > 0 AND unknown > 0 AND (successes + failures = 0 OR unproven = 0) AND episodes >= 10",
    "zero_leakage": "audited > 0 AND leaks = 0",
    "shadow_parity": "shadow_runs >= 100 AND crashes = 0",
}
_READY = f"""round(0.25 * least(1, episodes / 1000) + 0.25 * (least(1, successes / 200) + least(1, failures / 100)) / 2 + 0.15 * least(1, {_COVER} / 0.8)
  + 0.15 * CASE WHEN {_GATES['rights_clearance']} THEN 1 ELSE 0 END + 0.1 * CASE WHEN {_GATES['zero_leakage']} THEN 1 ELSE 0 END + 0.1 * least(1, shadow_runs / 100), 2)"""


@query(f"SELECT {', '.join(f'{v} AS {k}' for k, v in _GATES.items())}, ({_READY})::DOUBLE AS readiness_score FROM {_POPULATION}")
def a28_readiness_gates(spark, folder):
    p = population(spark, folder)
    cover = F.when(c("episodes") > 0, F.round(c("logged") / c("episodes"), 3)).otherwise(0.0)
    one = F.lit(1.0)
    gates = {
        "total_episodes": c("episodes") >= 1000,
        "verified_outcomes": (c("successes") >= 200) & (c("failures") >= 100),
        "candidate_logging": (c("episodes") > 0) & (cover >= 0.8),
        "rights_clearance": (c("episodes") > 0) & (c("unpermitted") + c("revoked") == 0),
        "supervision_diversity": (c("successes") > 0) & (c("failures") > 0) & (c("unknown") > 0) & (c("unproven") == 0) & (c("episodes") >= 10),
        "zero_leakage": (c("audited") > 0) & (c("leaks") == 0),
        "shadow_parity": (c("shadow_runs") >= 100) & (c("crashes") == 0),
    }
    outcome = (F.least(one, c("successes") / 200) + F.least(one, c("failures") / 100)) / 2
    score = 0.25 * F.least(one, c("episodes") / 1000) + 0.25 * outcome + 0.15 * F.least(one, cover / 0.8) + 0.15 * gates["rights_clearance"].cast("int") + 0.1 * gates["zero_leakage"].cast("int") + 0.1 * F.least(one, c("shadow_runs") / 100)
    return p.select(*[t.alias(k) for k, t in gates.items()], F.round(score, 2).alias("readiness_score"))


@query("SELECT event_type AS category, CASE WHEN value > 50 THEN 'SUCCESS' ELSE 'FAILURE' END AS status, count(*) AS n FROM events GROUP BY ALL")
def a30_call_statistics(spark, folder):
    return table(spark, folder, "events").groupBy(c("event_type").alias("category"), F.when(c("value") > 50, "SUCCESS").otherwise("FAILURE").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT type, count(*) AS n, min(sequence) AS first_at FROM {TRAJECTORY} GROUP BY ALL")
def a02_event_types(spark, folder):
    return trajectory(spark, folder).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("sequence").alias("first_at"))
