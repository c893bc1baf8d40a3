"""Ranking metrics, paired comparison and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import settled


def budgeted(ranked: DataFrame, limit: int) -> DataFrame:
    """Ranked rows (task_id, rank, unit_id, tokens) that fit a token limit taken in order of rank, misfits skipped; ranks anew.

    The fold over a task's ranked rows has no window form: what is skipped depends on what was taken.
    """
    cost = F.when(F.col("tokens").isNull() | (F.col("tokens") == 0), F.lit(100)).otherwise(F.col("tokens")).cast("long")
    rows = ranked.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("rank", "unit_id", cost.alias("tokens")))).alias("rows"))
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.slice("rows", 1, 0).alias("taken"))

    def add(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["tokens"] <= limit
        return F.struct(F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["taken"], F.array(x))).otherwise(acc["taken"]).alias("taken"))

    out = rows.select("task_id", F.posexplode(F.aggregate("rows", empty, add, lambda acc: acc["taken"])).alias("i", "x"))
    return out.select("task_id", (F.col("i") + 1).alias("rank"), "x.unit_id", "x.tokens")


def ideal_dcg(targets: Column, k: int) -> Column:
    """The DCG at k of a ranking that has all targets first."""
    return F.aggregate(F.sequence(F.lit(1), F.least(targets, F.lit(k)).cast("int")), F.lit(0.0), lambda acc, t: acc + 1 / F.log2(t + 1))


def task_metrics(ranked: DataFrame, targets: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """For each task with targets (task_id, unit_id): first_hit_rank, mrr, dcg, ndcg and recall at each k. ranked: task_id, rank, unit_id.

    A target counts at its first hit only; a rank that newly covers several targets counts once.
    """
    n = targets.groupBy("task_id").agg(F.count_distinct("unit_id").alias("targets"))
    hits = targets.distinct().join(ranked, ["task_id", "unit_id"]).groupBy("task_id", "unit_id").agg(F.min("rank").alias("rank"))
    gain = 1 / F.log2(F.col("rank") + 1)
    ranks = hits.select("task_id", "rank").distinct().groupBy("task_id").agg(F.min("rank").alias("first_hit_rank"), *[F.sum(F.when(F.col("rank") <= k, gain)).alias(f"dcg{k}") for k in ks])
    found = hits.groupBy("task_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"hits{k}") for k in ks])
    rows = n.join(ranks, "task_id", "left").join(found, "task_id", "left")
    return rows.select(
        "task_id",
        F.coalesce("first_hit_rank", F.lit(0)).alias("first_hit_rank"),
        F.round(F.coalesce(1 / F.col("first_hit_rank"), F.lit(0.0)), 4).alias("mrr"),
        *[F.round(F.least(F.lit(1.0), F.coalesce(f"dcg{k}", F.lit(0.0)) / ideal_dcg(F.col("targets"), k)), 4).alias(f"ndcg{k}") for k in ks],
        *[F.round(F.coalesce(f"hits{k}", F.lit(0)) / F.col("targets"), 4).alias(f"recall{k}") for k in ks],
    )


def graded_ndcg(ranked: DataFrame, k: int, exponential: bool = False) -> DataFrame:
    """ndcg of graded rows (task_id, rank, grade; null grade is 0), all of a task's rows being its ideal; 1 where nothing is relevant."""
    g = F.coalesce(F.col("grade"), F.lit(0)).cast("double")
    gain = F.pow(F.lit(2.0), g) - 1 if exponential else g
    rows = ranked.withColumn("gain", gain).withColumn("best", F.row_number().over(Window.partitionBy("task_id").orderBy(F.col("gain").desc(), "rank")))
    at = lambda r: F.sum(F.when(F.col(r) <= k, F.col("gain") / F.log2(F.col(r) + 1)).otherwise(0.0))
    out = rows.groupBy("task_id").agg(at("rank").alias("dcg"), at("best").alias("ideal"))
    return out.select("task_id", F.when(F.col("ideal") == 0, 1.0).otherwise(F.round(F.col("dcg") / F.col("ideal"), 4)).alias("ndcg"))


#: Stretches of a key's range of values among which a place in its order is looked up first.
STRETCHES = 4096


def descriptive(df: DataFrame, key: str, value: str) -> DataFrame:
    """mean, population deviation, least, greatest, p95 (the sorted value at floor(.95 n)) and median (at floor(n / 2)) of each key.

    The two places are found exactly without sorting a key's values: counts by stretch of its range tell the stretch that holds each place,
    and only that stretch's values are counted and put in order.
    """
    rows = df.select(key, F.col(value).alias("v")).filter("v is not null")
    stats = settled(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"), F.min("v").alias("least"), F.max("v").alias("greatest")), "moments")
    width = F.col("greatest") - F.col("least")
    at = F.when(width > 0, F.least(F.lit(STRETCHES - 1), F.floor((F.col("v") - F.col("least")) / width * STRETCHES).cast("int"))).otherwise(0)
    placed = rows.join(stats.select(key, "least", "greatest"), key).select(key, at.alias("stretch"), "v")
    counts = placed.groupBy(key, "stretch").agg(F.count(F.lit(1)).alias("_held"))
    places = F.explode(F.array(F.struct(F.lit("p95").alias("what"), F.floor(0.95 * F.col("n")).alias("place")), F.struct(F.lit("median").alias("what"), F.floor(F.col("n") / 2).alias("place")))).alias("x")
    before = F.sum("_held").over(Window.partitionBy(key).orderBy("stretch")) - F.col("_held")
    wanted = counts.withColumn("before", before).join(stats.select(key, places).select(key, "x.*"), key).filter("place >= before and place < before + _held")
    wanted = settled(wanted.select(key, "stretch", "what", (F.col("place") - F.col("before")).alias("place")), "places")
    values = placed.join(wanted, [key, "stretch"]).groupBy(key, "what", "place", "v").agg(F.count(F.lit(1)).alias("_held"))
    upto = F.sum("_held").over(Window.partitionBy(key, "what").orderBy("v"))
    found = values.withColumn("upto", upto).filter("upto > place").groupBy(key).agg(F.min(F.when(F.col("what") == "p95", F.col("v"))).alias("p95"), F.min(F.when(F.col("what") == "median", F.col("v"))).alias("median"))
    return stats.join(found, key).select(key, F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"), "least", "greatest", "p95", "median")


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation; 0 where either side doesn't vary."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), F.covar_pop(x, y) / F.when(sx * sy > 0, sx * sy)).otherwise(0.0)


def deltas(baseline: DataFrame, candidate: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """candidate minus baseline of each measure; a missing baseline counts as 0."""
    b = baseline.select(*keys, *[F.col(m).alias(f"b_{m}") for m in measures])
    return candidate.join(b, keys, "left").select(*keys, *[(F.col(m) - F.coalesce(f"b_{m}", F.lit(0.0))).alias(f"{m}_delta") for m in measures])


def wins_ties_losses(delta: str, eps: float = 0.0001) -> list[Column]:
    return [F.count_if(F.col(delta) > eps).alias("wins"), F.count_if(F.abs(F.col(delta)) <= eps).alias("ties"), F.count_if(F.col(delta) < -eps).alias("losses")]


#: Fixed values of the linear congruential generator that resampling and splits draw from.
LCG = (9301, 49297, 233280)


def lcg_jump(seed: int, steps: Column) -> Column:
    """The generator's state after a number of steps, by repeated squaring of its affine map: any draw without those before it."""
    a, c, m = LCG
    maps = []
    for _ in range(40):
        maps.append((a, c))
        a, c = a * a % m, (c * a + c) % m
    mul, add = (F.array(*[F.lit(x[k]).cast("long") for x in maps]) for k in range(2))

    def step(state: Column, bit: Column) -> Column:
        taken = F.floor(steps / F.pow(F.lit(2.0), bit)).cast("long") % 2
        return F.when(taken == 1, (state * F.get(mul, bit) + F.get(add, bit)) % m).otherwise(state)

    return F.aggregate(F.sequence(F.lit(0), F.lit(39)), F.lit(seed).cast("long"), step)


def bootstrap(sample: DataFrame, iterations: int = 2000, seed: int = 42) -> DataFrame:
    """mean, bounds of the 95 % interval, p value, wins, ties and losses of a sample (i from 0, delta) resampled with the generator.

    Draw j of iteration k is the generator's state after k n + j + 1 steps. The generator has a full period of LCG[2] states, so the values
    drawn over one period are added up once, exactly, and each iteration's sum is a difference of two such sums and whole periods:
    iterations cost a row each, however large the sample. The means are ordered once: their number is a parameter, not the data's.
    """
    spark = sample.sparkSession
    n = sample.count()
    m = LCG[2]
    rows = sample.select("i", F.col("delta").cast("decimal(30,12)").alias("d"))
    drawn = spark.range(1, m + 1).select(F.col("id").alias("s"), F.floor(lcg_jump(seed, F.col("id")) * n / m).alias("i")).join(rows, "i")
    sums = drawn.select("s", F.sum("d").over(Window.orderBy("s")).alias("sum"))  # one period: a fixed number of rows
    sums = settled(sums.unionByName(spark.range(1).select(F.col("id").alias("s"), F.lit(0).cast("decimal(38,12)").alias("sum"))), "period")
    ends = spark.range(iterations).select("id", F.explode(F.array(F.struct(F.lit(-1).alias("sign"), (F.col("id") * n).alias("t")), F.struct(F.lit(1).alias("sign"), ((F.col("id") + 1) * n).alias("t")))).alias("x")).select("id", "x.*")
    whole = F.broadcast(sums.filter(F.col("s") == m).select(F.col("sum").alias("whole")))
    parts = ends.withColumn("s", F.col("t") % m).join(sums, "s").crossJoin(whole)
    total = F.col("sign") * (F.expr(f"t div {m}").cast("decimal(18,0)") * F.col("whole") + F.col("sum"))
    means = parts.groupBy("id").agg((F.sum(total).cast("double") / n).alias("mean"))
    ordered = means.select("mean", (F.row_number().over(Window.orderBy("mean")) - 1).alias("place"))
    whole = sample.agg(F.avg("delta").alias("m"), *wins_ties_losses("delta"))
    at = lambda p: F.max(F.when(F.col("place") == int(iterations * p), F.col("mean")))
    stats = ordered.agg(at(0.025).alias("low"), at(0.975).alias("high"), F.count_if(F.round("mean", 12) <= 0).alias("under"), F.count_if(F.round("mean", 12) >= 0).alias("over"))
    extreme = F.when(F.col("m") >= 0, F.col("under")).otherwise(F.col("over"))
    return whole.crossJoin(stats).select(F.round("m", 4).alias("mean_delta"), F.round("low", 4).alias("ci_lower"), F.round("high", 4).alias("ci_upper"), F.round(F.least(F.lit(1.0), 2.0 * extreme / iterations), 4).alias("p_value"), "wins", "ties", "losses")


def mcnemar(b: Column, c: Column) -> Column:
    """Struct of statistic (with continuity correction) and exact two-sided p for the discordant counts b and c."""
    n = (b + c).cast("double")
    num = F.greatest(F.lit(0), F.abs(b - c) - 1)
    choose = lambda k: F.aggregate(F.sequence(F.lit(1), k), F.lit(1.0), lambda acc, i: acc * (n - (k - i)) / i)
    least = F.least(b, c).cast("int")
    terms = F.transform(F.sequence(F.lit(0), least), lambda k: F.when(k == 0, 1.0).otherwise(choose(F.greatest(k, F.lit(1)))) * F.pow(F.lit(0.5), n))
    p = F.least(F.lit(1.0), 2 * F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x))
    return F.struct(F.when(n == 0, 0.0).otherwise(F.round(num * num / n, 4)).alias("statistic"), F.when(n == 0, 1.0).otherwise(F.round(p, 4)).alias("p_value"))


#: Fixed values of the normal tail's polynomial.
TAIL = (0.2316419, 0.3989423, (0.3193815, -0.3565638, 1.781478, -1.821256, 1.330274))


def paired_t(n: Column, mean: Column, variance: Column) -> Column:
    """p of a paired test from count, mean and sample variance of differences; the tail is that of the normal distribution."""
    se = F.sqrt(variance / n)
    z = F.abs(mean / F.when(se > 0, se))
    t = 1 / (1 + TAIL[0] * z)
    poly = F.lit(0.0)
    for x in reversed(TAIL[2]):
        poly = (poly + x) * t
    p = 2 * TAIL[1] * F.exp(-z * z / 2) * poly
    return F.when(n < 2, 1.0).when(se == 0, F.when(mean == 0, 1.0).otherwise(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)), 4))


def offline_gate(ndcg: Column, wins: Column, losses: Column, recall: Column, mrr: Column, worst_repository: Column) -> Column:
    """The first failing reason of promotion, or PASSED."""
    return F.when(ndcg < 0, "NDCG").when(wins < losses, "LOSSES").when(recall < -0.05, "RECALL").when(mrr < -0.05, "MRR").when(worst_repository < -0.15, "REPOSITORY").otherwise("PASSED")
