"""Queries of ranking metrics, paired comparison and statistics."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.metrics import LCG, bootstrap, budgeted, correlation, deltas, descriptive, graded_ndcg, ideal_dcg, lcg_jump, mcnemar, offline_gate, paired_t, task_metrics, wins_ties_losses
from tessera.operators.retrieval import containing
from tessera.operators.training import numbered
from tessera.registry import query
from tessera.plans.retrieval import _SCORES, lexical_top
from tessera.sources.tables import TASKS, UNITS, table, tasks, units

_RANKED = f"(SELECT task_id, unit_id, row_number() OVER (PARTITION BY task_id ORDER BY lexical_score DESC, unit_id) AS rank FROM {_SCORES} QUALIFY rank <= 50)"
_TARGETS = f"(SELECT t.task_id, u.unit_id FROM {UNITS} u JOIN {TASKS} t ON contains(u.content, t.passage))"


def c(name):
    return F.col(name)


def ranked(spark, folder):
    return lexical_top(spark, folder, 50).select("task_id", "unit_id", "rank")


def targets(spark, folder):
    return containing(units(spark, folder), tasks(spark, folder), "content", "passage").select("task_id", "unit_id")


def _ideal(k):
    return f"list_sum(list_transform(range(1, least(targets, {k}) + 1), lambda t: 1 / log2(t + 1)))"


def _metrics_sql(ranked_sql, targets_sql):
    return f"""(WITH h AS (SELECT t.task_id, t.unit_id, r.rank FROM {targets_sql} t LEFT JOIN {ranked_sql} r ON r.task_id = t.task_id AND r.unit_id = t.unit_id),
    d AS (SELECT DISTINCT task_id, rank FROM h WHERE rank IS NOT NULL),
    g AS (SELECT task_id, min(rank) AS f, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS d5, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS d10, sum(CASE WHEN rank <= 20 THEN 1 / log2(rank + 1) ELSE 0 END) AS d20 FROM d GROUP BY task_id),
    n AS (SELECT task_id, count(*) AS targets, count(*) FILTER (WHERE rank <= 5) AS h5, count(*) FILTER (WHERE rank <= 10) AS h10, count(*) FILTER (WHERE rank <= 20) AS h20 FROM h GROUP BY task_id)
    SELECT task_id, coalesce(f, 0) AS first_hit_rank, round(coalesce(1 / f, 0), 4) AS mrr, round(least(1, coalesce(d5, 0) / {_ideal(5)}), 4) AS ndcg5, round(least(1, coalesce(d10, 0) / {_ideal(10)}), 4) AS ndcg10,
    round(least(1, coalesce(d20, 0) / {_ideal(20)}), 4) AS ndcg20, round(h5 / targets, 4) AS recall5, round(h10 / targets, 4) AS recall10, round(h20 / targets, 4) AS recall20 FROM n LEFT JOIN g USING (task_id))"""


_METRICS = _metrics_sql(_RANKED, _TARGETS)


@query(f"SELECT * FROM {_METRICS}")
def w03_task_metrics(spark, folder):
    """First hit, MRR, de-duplicated DCG over ideal DCG, distinct hits at k (w03 to w06)."""
    return task_metrics(ranked(spark, folder), targets(spark, folder))


@query(f"SELECT task_id, first_hit_rank, mrr FROM {_METRICS}")
def w04_first_hits(spark, folder):
    return task_metrics(ranked(spark, folder), targets(spark, folder)).select("task_id", "first_hit_rank", "mrr")


@query("SELECT l_orderkey AS task_id, count(DISTINCT l_partkey) AS targets, round(list_sum(list_transform(range(1, least(count(DISTINCT l_partkey), 5) + 1), lambda t: 1 / log2(t + 1))), 6) AS ideal FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey")
def w05_ideal_dcg(spark, folder):
    """The best DCG at 5 that a task can have: all of its targets (units that were read) come first."""
    found = table(spark, folder, "lineitem").filter("l_returnflag <> 'N'").groupBy(c("l_orderkey").alias("task_id")).agg(F.count_distinct("l_partkey").alias("targets"))
    return found.select("task_id", "targets", F.round(ideal_dcg(c("targets").cast("int"), 5), 6).alias("ideal"))


@query(f"SELECT task_id, recall5, recall10, recall20 FROM {_METRICS}")
def w06_distinct_hits(spark, folder):
    return task_metrics(ranked(spark, folder), targets(spark, folder)).select("task_id", "recall5", "recall10", "recall20")


_LINES = "(SELECT l_orderkey AS task_id, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS tokens FROM lineitem)"


@query(f"""WITH RECURSIVE r AS (SELECT task_id, line, CASE WHEN tokens % 10 = 0 THEN 100 ELSE tokens END AS cost, row_number() OVER (PARTITION BY task_id ORDER BY line) AS n FROM (SELECT DISTINCT ON (task_id, line) * FROM {_LINES} ORDER BY ALL)),
  s(task_id, n, used, line, took) AS (SELECT task_id, 0, 0, 0, false FROM (SELECT DISTINCT task_id FROM r) UNION ALL
   SELECT s.task_id, r.n, used + CASE WHEN used + cost <= 120 THEN cost ELSE 0 END, r.line, used + cost <= 120 FROM s JOIN r ON r.task_id = s.task_id AND r.n = s.n + 1)
  SELECT task_id, line, row_number() OVER (PARTITION BY task_id ORDER BY n) AS rank FROM s WHERE took""")
def w02_token_budget(spark, folder):
    rows = table(spark, folder, "lineitem").groupBy(c("l_orderkey").alias("task_id"), c("l_linenumber").alias("rank")).agg(F.min(c("l_quantity").cast("long")).alias("tokens"))
    rows = rows.withColumn("unit_id", c("rank")).withColumn("tokens", F.when(c("tokens") % 10 != 0, c("tokens")))
    return budgeted(rows, 120).select("task_id", c("unit_id").alias("line"), "rank")


_GRADES = f"(SELECT r.task_id, r.rank, CASE WHEN t.unit_id IS NOT NULL THEN 3 ELSE CASE r.unit_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 END END AS grade FROM {_RANKED} r LEFT JOIN {_TARGETS} t USING (task_id, unit_id))"


def _graded(spark, folder):
    hit = targets(spark, folder).withColumn("hit", F.lit(True))
    u = c("unit_id") % 7
    return ranked(spark, folder).join(hit, ["task_id", "unit_id"], "left").select("task_id", "rank", F.when(c("hit"), 3).when(u == 0, 1).when(u == 1, 2).alias("grade"))


def _graded_sql(gain):
    return f"""WITH g AS (SELECT task_id, rank, {gain} AS gain FROM (SELECT task_id, rank, coalesce(grade, 0) AS grade FROM {_GRADES})), b AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY gain DESC, rank) AS best FROM g)
  SELECT task_id, CASE WHEN i = 0 THEN 1.0 ELSE round(d / i, 4) END::DOUBLE AS ndcg FROM (SELECT task_id, sum(CASE WHEN rank <= 10 THEN gain / log2(rank + 1) ELSE 0 END) AS d, sum(CASE WHEN best <= 10 THEN gain / log2(best + 1) ELSE 0 END) AS i FROM b GROUP BY task_id)"""


@query(_graded_sql("CAST(grade AS DOUBLE)"))
def w07_graded_ndcg(spark, folder):
    return graded_ndcg(_graded(spark, folder), 10)


@query(_graded_sql("pow(2, grade) - 1"))
def w07_exponential_ndcg(spark, folder):
    return graded_ndcg(_graded(spark, folder), 10, exponential=True)


@query(f"""SELECT t.task_id, {', '.join(f'CASE WHEN n.n IS NULL THEN 1.0 ELSE round(coalesce(h.h{k}, 0) / n.n, 4) END::DOUBLE AS recall{k}' for k in (20, 50, 100, 200))} FROM {TASKS} t
  LEFT JOIN (SELECT task_id, count(*) AS n FROM {_TARGETS} GROUP BY ALL) n USING (task_id)
  LEFT JOIN (SELECT task_id, {', '.join(f'count(*) FILTER (WHERE rank <= {k}) AS h{k}' for k in (20, 50, 100, 200))} FROM {_TARGETS} JOIN (SELECT task_id, unit_id, row_number() OVER (PARTITION BY task_id ORDER BY lexical_score DESC, unit_id) AS rank FROM {_SCORES}) USING (task_id, unit_id) GROUP BY ALL) h USING (task_id)""")
def w08_recall(spark, folder):
    t = tasks(spark, folder).select("task_id")
    found = lexical_top(spark, folder, 200)
    hits = targets(spark, folder).join(found, ["task_id", "unit_id"], "left").groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c("rank") <= k).alias(f"h{k}") for k in (20, 50, 100, 200)])
    return t.join(hits, "task_id", "left").select("task_id", *[F.when(c("n").isNull(), 1.0).otherwise(F.round(c(f"h{k}") / c("n"), 4)).alias(f"recall{k}") for k in (20, 50, 100, 200)])


_CONFIGS = {"lexical": ["lexical"], "lexical_plus_imports": ["lexical", "imports"], "all": ["lexical", "imports", "calls"]}
_CHANNELS = f"(SELECT task_id, unit_id, CASE unit_id % 3 WHEN 0 THEN 'lexical' WHEN 1 THEN 'imports' ELSE 'calls' END AS channel FROM {_RANKED})"


@query(f"""WITH cfg AS (SELECT * FROM (VALUES ('lexical', 'lexical'), ('lexical_plus_imports', 'lexical'), ('lexical_plus_imports', 'imports'), ('all', 'lexical'), ('all', 'imports'), ('all', 'calls')) v(config, channel)),
  r AS (SELECT config, round(count(x.unit_id) / count(*), 4) AS recall FROM (SELECT DISTINCT config FROM cfg) g CROSS JOIN {_TARGETS} t LEFT JOIN (SELECT config, task_id, unit_id FROM {_CHANNELS} JOIN cfg USING (channel)) x USING (config, task_id, unit_id) GROUP BY ALL)
  SELECT config, recall, round(recall - (SELECT recall FROM r WHERE config = 'lexical_plus_imports'), 4) AS uplift FROM r""")
def w09_recall_ablation(spark, folder):
    u = c("unit_id") % 3
    found = ranked(spark, folder).select("task_id", "unit_id", F.when(u == 0, "lexical").when(u == 1, "imports").otherwise("calls").alias("channel"))
    configs = F.explode(F.array(*[F.struct(F.lit(k).alias("config"), F.array(*map(F.lit, v)).alias("channels")) for k, v in _CONFIGS.items()]))
    goals = targets(spark, folder).select("*", configs.alias("g")).select("task_id", "unit_id", "g.*")
    rows = goals.join(found, ["task_id", "unit_id"], "left").withColumn("hit", F.coalesce(F.array_contains("channels", c("channel")), F.lit(False)))
    r = rows.groupBy("config").agg(F.round(F.count_if("hit") / F.count(F.lit(1)), 4).alias("recall"))
    base = F.max(F.when(c("config") == "lexical_plus_imports", c("recall"))).over(Window.partitionBy())  # a row for each configuration
    return r.select("config", "recall", F.round(c("recall") - base, 4).alias("uplift"))


@query(f"SELECT count(*) AS tasks, round(sum(coalesce(ndcg10, 0)) / count(*), 4) AS ndcg10, round(sum(coalesce(recall10, 0)) / count(*), 4) AS recall10, round(sum(coalesce(mrr, 0)) / count(*), 4) AS mrr, round(count(*) FILTER (WHERE first_hit_rank > 0) / count(*), 4) AS coverage FROM {TASKS} LEFT JOIN {_METRICS} USING (task_id)")
def a18_ranking_aggregate(spark, folder):
    m = tasks(spark, folder).select("task_id").join(task_metrics(ranked(spark, folder), targets(spark, folder)), "task_id", "left")
    n = F.count(F.lit(1))
    return m.agg(n.alias("tasks"), *[F.round(F.sum(F.coalesce(x, F.lit(0.0))) / n, 4).alias(x) for x in ("ndcg10", "recall10", "mrr")], F.round(F.count_if(c("first_hit_rank") > 0) / n, 4).alias("coverage"))


_DELTAS = "(SELECT o_orderkey AS task_id, o_custkey % 5 AS repository, o_orderpriority AS task_type, round((o_orderkey % 17 - 8) / 100.0 * (o_custkey % 3), 4)::DOUBLE AS delta FROM orders)"


def paired(spark, folder):
    k = c("o_orderkey")
    return table(spark, folder, "orders").select(k.alias("task_id"), (c("o_custkey") % 5).alias("repository"), c("o_orderpriority").alias("task_type"), F.round((k % 17 - 8) / 100.0 * (c("o_custkey") % 3), 4).alias("delta"))


@query(f"SELECT 'repository' AS by, CAST(repository AS VARCHAR) AS value, round(avg(delta), 4) AS mean_delta FROM {_DELTAS} GROUP BY ALL UNION ALL SELECT 'task_type', task_type, round(avg(delta), 4) FROM {_DELTAS} GROUP BY ALL")
def a19_stratified_deltas(spark, folder):
    keys = F.explode(F.array(F.struct(F.lit("repository").alias("by"), c("repository").cast("string").alias("value")), F.struct(F.lit("task_type").alias("by"), c("task_type").alias("value"))))
    return paired(spark, folder).select(keys.alias("k"), "delta").groupBy("k.by", "k.value").agg(F.round(F.avg("delta"), 4).alias("mean_delta"))


@query(f"SELECT repository, count(*) FILTER (WHERE delta > 0.0001) AS wins, count(*) FILTER (WHERE abs(delta) <= 0.0001) AS ties, count(*) FILTER (WHERE delta < -0.0001) AS losses FROM {_DELTAS} GROUP BY ALL")
def a20_win_tie_loss(spark, folder):
    return paired(spark, folder).groupBy("repository").agg(*wins_ties_losses("delta"))


@query("""WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  SELECT event_type, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS deviation, min(v) AS least, max(v) AS greatest, max(v) FILTER (WHERE i = floor(0.95 * n)) AS p95, max(v) FILTER (WHERE i = floor(n / 2)) AS median FROM r GROUP BY event_type""")
def a23_descriptive(spark, folder):
    return descriptive(table(spark, folder, "events"), "event_type", "value")


@query("SELECT l_returnflag, round(coalesce(corr(l_quantity, l_extendedprice), 0), 4) AS r, 0.0::DOUBLE AS flat FROM lineitem GROUP BY ALL")
def a24_correlation(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("one", F.lit(1.0))
    return lines.groupBy("l_returnflag").agg(F.round(correlation("l_quantity", "l_extendedprice"), 4).alias("r"), correlation("l_quantity", "one").alias("flat"))


@query("SELECT c.o_orderkey AS episode_id, round(c.o_totalprice - coalesce(b.p, 0), 2) AS price_delta FROM orders c LEFT JOIN (SELECT o_orderkey AS k, o_totalprice / 3 AS p FROM orders WHERE o_orderkey % 7 > 0) b ON k = c.o_orderkey")
def j25_paired_deltas(spark, folder):
    orders = table(spark, folder, "orders").select(c("o_orderkey").alias("episode_id"), c("o_totalprice").alias("price"))
    base = orders.filter("episode_id % 7 > 0").withColumn("price", c("price") / 3)
    return deltas(base, orders, ["episode_id"], ["price"]).select("episode_id", F.round("price_delta", 2).alias("price_delta"))


_SAMPLE = f"(SELECT row_number() OVER (ORDER BY task_id) - 1 AS i, delta FROM {_DELTAS})"


def _sample(spark, folder):
    """The paired delta of each task, numbered: resampling draws tasks."""
    return numbered(paired(spark, folder).select("task_id", "delta"), "task_id").select(c("number").alias("i"), "delta")


def _states_sql():
    """One period of the generator from 42 on, doubled again and again: table g(j, x), x after j steps."""
    (a, add, m), parts = LCG, ["t0 AS (SELECT 0::BIGINT AS j, 42::BIGINT AS x)"]
    for k in range(18):
        parts.append(f"t{k + 1} AS (SELECT * FROM t{k} UNION ALL SELECT j + {1 << k}, (x * {a} + {add}) % {m} FROM t{k})")
        a, add = a * a % m, (a * add + add) % m
    return ", ".join([*parts, f"g AS (SELECT j, x FROM t18 WHERE j BETWEEN 1 AND {m})"])


_M = LCG[2]


@query(f"""WITH s AS (SELECT * FROM {_SAMPLE}), n AS (SELECT count(*) AS n FROM s), {_states_sql()},
  v AS (SELECT j, sum(d) OVER (ORDER BY j) AS c FROM (SELECT j, delta::DECIMAL(18, 6) AS d FROM g, n JOIN s ON s.i = CAST(floor(x * n / {_M}.0) AS BIGINT)) UNION ALL SELECT 0, 0), w1 AS (SELECT c AS whole FROM v WHERE j = {_M}),
  m AS (SELECT k, CAST((b.c + whole * ((k + 1) * n // {_M})) - (a.c + whole * (k * n // {_M})) AS DOUBLE) / n AS mean FROM range(0, 2000) r(k), n, w1 JOIN v a ON a.j = k * n % {_M} JOIN v b ON b.j = (k + 1) * n % {_M}),
  o AS (SELECT mean, row_number() OVER (ORDER BY mean) - 1 AS place FROM m), w AS (SELECT avg(delta) AS m, count(*) FILTER (WHERE delta > 0.0001) AS wins, count(*) FILTER (WHERE abs(delta) <= 0.0001) AS ties, count(*) FILTER (WHERE delta < -0.0001) AS losses FROM s)
  SELECT round(m, 4) AS mean_delta, (SELECT round(mean, 4) FROM o WHERE place = 50) AS ci_lower, (SELECT round(mean, 4) FROM o WHERE place = 1950) AS ci_upper,
  round(least(1, 2 * CASE WHEN m >= 0 THEN (SELECT count(*) FROM o WHERE round(mean, 12) <= 0) ELSE (SELECT count(*) FROM o WHERE round(mean, 12) >= 0) END / 2000), 4) AS p_value, wins, ties, losses FROM w""")
def e01_bootstrap(spark, folder):
    return bootstrap(_sample(spark, folder))


@query(f"WITH {_states_sql()} SELECT o_orderkey, x AS state FROM orders JOIN g ON j = o_orderkey % {_M} + 1")
def l17_generator(spark, folder):
    """The draw that belongs to each task by its number: the generator jumps to it, no draws are made in order."""
    return table(spark, folder, "orders").select("o_orderkey", lcg_jump(42, c("o_orderkey") % _M + 1).alias("state"))


def _mcnemar_sql(b, x):
    p = f"least(1, 2 * list_sum(list_transform(range(0, least({b}, {x}) + 1), lambda k: factorial(({b} + {x})::INT) / (factorial(k::INT) * factorial(({b} + {x} - k)::INT)) * pow(0.5, {b} + {x}))))"
    return f"CASE WHEN {b} + {x} = 0 THEN 0.0 ELSE round(pow(greatest(0, abs({b} - {x}) - 1), 2) / ({b} + {x}), 4) END::DOUBLE AS statistic, CASE WHEN {b} + {x} = 0 THEN 1.0 ELSE round({p}, 4) END::DOUBLE AS p_value"


_DISCORDANT = "(SELECT l_orderkey AS task_id, (count(*) FILTER (WHERE l_returnflag = 'A'))::INT AS b, (count(*) FILTER (WHERE l_returnflag = 'R'))::INT AS c FROM lineitem GROUP BY ALL)"


@query(f"SELECT task_id, b, c, {_mcnemar_sql('b', 'c')} FROM {_DISCORDANT}")
def e02_mcnemar(spark, folder):
    """Paired outcomes of each task's runs: those that one side alone solved, and those that the other alone did."""
    rows = table(spark, folder, "lineitem").groupBy(c("l_orderkey").alias("task_id")).agg(*[F.count_if(c("l_returnflag") == f).cast("int").alias(n) for f, n in (("A", "b"), ("R", "c"))])
    return rows.select("task_id", "b", "c", mcnemar(c("b"), c("c")).alias("m")).select("task_id", "b", "c", "m.*")


_T = "(1 / (1 + 0.2316419 * z))"


@query(f"""SELECT repository, CASE WHEN n < 2 THEN 1.0 WHEN se = 0 THEN CASE WHEN m = 0 THEN 1.0 ELSE 0.0 END ELSE round(greatest(0, least(1, 2 * 0.3989423 * exp(-z * z / 2) * {_T} * (0.3193815 + {_T} * (-0.3565638 + {_T} * (1.781478 + {_T} * (-1.821256 + {_T} * 1.330274)))))), 4) END::DOUBLE AS p_value
  FROM (SELECT *, abs(m / nullif(se, 0)) AS z FROM (SELECT repository, count(*) AS n, avg(delta) AS m, sqrt(var_samp(delta) / count(*)) AS se FROM {_DELTAS} GROUP BY ALL))""")
def e03_paired_t_test(spark, folder):
    g = paired(spark, folder).groupBy("repository").agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("m"), F.var_samp("delta").alias("v"))
    return g.select("repository", paired_t(c("n"), c("m"), c("v")).alias("p_value"))


@query(f"""WITH r AS (SELECT task_type, repository, avg(delta) AS d FROM {_DELTAS} GROUP BY ALL), t AS (SELECT task_type, avg(delta) AS nd, avg(delta) - 0.051 AS rd, avg(delta) * 2 AS md, count(*) FILTER (WHERE delta > 0.0001) AS w, count(*) FILTER (WHERE delta < -0.0001) AS l FROM {_DELTAS} GROUP BY ALL)
  SELECT task_type, CASE WHEN nd < 0 THEN 'NDCG' WHEN w < l THEN 'LOSSES' WHEN rd < -0.05 THEN 'RECALL' WHEN md < -0.05 THEN 'MRR' WHEN worst < -0.15 THEN 'REPOSITORY' ELSE 'PASSED' END AS decision FROM t JOIN (SELECT task_type, min(d) AS worst FROM r GROUP BY ALL) USING (task_type)""")
def e04_promotion_gate(spark, folder):
    p = paired(spark, folder)
    worst = p.groupBy("task_type", "repository").agg(F.avg("delta").alias("d")).groupBy("task_type").agg(F.min("d").alias("worst"))
    g = p.groupBy("task_type").agg(F.avg("delta").alias("m"), *wins_ties_losses("delta")).join(worst, "task_type")
    return g.select("task_type", offline_gate(c("m"), c("wins"), c("losses"), c("m") - 0.051, c("m") * 2, c("worst")).alias("decision"))


@query("SELECT o_custkey AS task_id, sha256(string_agg(o_orderkey || ':' || o_orderstatus, ';' ORDER BY o_orderkey)) AS plan_hash FROM orders GROUP BY ALL")
def e05_plan_hash(spark, folder):
    parts = F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat_ws(":", c("o_orderkey").cast("string"), "o_orderstatus").alias("s"))))
    return table(spark, folder, "orders").groupBy(c("o_custkey").alias("task_id")).agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["s"]), ";"), 256).alias("plan_hash"))
