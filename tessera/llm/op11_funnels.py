"""Ordered funnel counting by fills over rows that are sorted backwards in time.

A row of a funnel's first step starts an attempt. Attempts are united with the rows that may follow them, sorted by client and time
descending; the last candidate that is not null, read from the top, is then the earliest later one of its kind. Among equal times attempts
stand before candidates, so that only later rows count. Each further step fills again with attempts at the time of their last step.

An attempt looks ahead by WITHIN at most. So rows are dealt by client and stretch of time: a row also goes to the stretch before its own
if it lies in its own's first WITHIN, and attempts to their own alone. A stretch of BUCKET holds at most a row for each kind and time that
the clock can tell, however many rows a client has. Counts by funnel, client, step and time taken are written once; order statistics take
them by bins first, then in the one bin that holds the rank.

Rows with a null among client, kind and time are left out, repeated rows count once, an empty table gives no rows, other columns are ignored.
Clients without an attempt have no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Name: kinds of the steps, excluded kind.
FUNNELS: dict[str, tuple[tuple[str, ...], str | None]] = {
    "A": (("view", "click", "view", "purchase"), "error"),
    "B": (("signup", "view", "click", "purchase"), "error"),
    "C": (("click", "click", "purchase", "view"), "signup"),
}
#: Microseconds from the first step to the last; stretches of time in which a client's rows are sorted; bins of order statistics.
WITHIN = 300_000_000
BUCKET = 1_800_000_000
BIN = 1 << 14


def micros(rows: DataFrame, at: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is taken as it stands, whatever the session's zone."""
    if dict(rows.dtypes)[at] == "timestamp_ntz":
        since = F.col(f"`{at}`") - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
        return (since.cast("interval second").cast("decimal(18,6)") * 1_000_000).cast("long")
    return F.unix_micros(F.col(f"`{at}`").cast("timestamp"))


def _by_funnel(values: list[Column | None]) -> Column:
    """The value of the row's funnel (from 1); null for candidates and where there is none."""
    some = [(i, v) for i, v in enumerate(values, 1) if v is not None]
    if not some:
        return F.lit(None).cast("long")
    return reduce(lambda so_far, x: so_far.when(F.col("_funnel") == x[0], x[1]), some[1:], F.when(F.col("_funnel") == some[0][0], some[0][1]))


def dealt(rows: DataFrame, funnels: list[tuple[tuple[str, ...], str | None]], within: int, bucket: int) -> DataFrame:
    """Attempts (_funnel from 1) and candidates (0) of distinct (_client, _kind, _at) by _client and _bucket."""
    if bucket < within:
        raise ValueError("a stretch of time must be as long as an attempt at least")
    first = F.col("_at") - F.pmod("_at", F.lit(bucket))
    later = sorted({k for steps, out in funnels for k in (*steps[1:], out) if k is not None})
    wanted = F.col("_kind").isin(later)

    def copy(test: Column, start: Column, funnel: int) -> Column:
        return F.when(test, F.struct(start.alias("_bucket"), F.lit(funnel).alias("_funnel")))

    copies = [copy(wanted, first, 0), copy(wanted & (F.col("_at") - first < within), first - bucket, 0)]
    copies += [copy(F.col("_kind") == steps[0], first, i) for i, (steps, _) in enumerate(funnels, 1)]
    return rows.select("*", F.inline(F.array_compact(F.array(*copies))))


def attempts(rows: DataFrame, funnels: list[tuple[tuple[str, ...], str | None]], within: int = WITHIN, bucket: int = BUCKET) -> DataFrame:
    """_funnel, _client, and _d2 and so on: the microseconds that each reached step took from the one before, null from the first unreached one."""
    latest = Window.partitionBy("_client", "_bucket").orderBy(F.col("_at").desc_nulls_last(), (F.col("_funnel") == 0).asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt(rows, funnels, within, bucket).withColumn("_t1", F.when(F.col("_funnel") > 0, F.col("_at")))
    for step in range(1, max(len(steps) for steps, _ in funnels)):
        kinds = [steps[step] if step < len(steps) else None for steps, _ in funnels]
        asked = sorted({k for k in (*kinds, *(out for _, out in funnels)) if k is not None})
        names = {k: f"_next{i}" for i, k in enumerate(asked)}
        filled = {n: F.last(F.when((F.col("_funnel") == 0) & (F.col("_kind") == k), F.col("_at")), ignorenulls=True).over(latest) for k, n in names.items()}
        following = _by_funnel([F.col(names[k]) if k is not None else None for k in kinds])
        barred = _by_funnel([F.col(names[x]) if x is not None else None for _, x in funnels])
        reached = F.col("_at").isNotNull() & (F.col("_follows") <= F.col("_t1") + within) & (F.col("_barred").isNull() | (F.col("_barred") > F.col("_follows")))
        out = out.withColumns(filled).withColumns({"_follows": following, "_barred": barred})
        out = out.withColumns({f"_d{step + 1}": F.when(reached, F.col("_follows") - F.col("_at")), "_at": F.when(F.col("_funnel") == 0, F.col("_at")).otherwise(F.when(reached, F.col("_follows")))})
        out = out.drop("_follows", "_barred", *names.values())
    return out.filter("_funnel > 0").drop("_kind", "_bucket", "_at", "_t1")


def ranked(counts: DataFrame, keys: list[str], value: str, n: str, percent: int, width: int = BIN) -> DataFrame:
    """keys and value: the ceil(percent * total / 100)-th smallest value of each group, of counts of values from 0 up.

    A window sees the bins of one group, then the values of one bin.
    """
    binned = counts.withColumn("_bin", F.floor(F.col(value) / width))
    group, in_order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bin")
    bins = binned.groupBy(*keys, "_bin").agg(F.sum(n).alias("_n"))
    bins = bins.select("*", F.sum("_n").over(in_order).alias("_upto"), F.ceil(F.sum("_n").over(group) * percent / 100).alias("_rank"))
    bins = bins.filter("_upto >= _rank AND _upto - _n < _rank").select(*keys, "_bin", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
    within = Window.partitionBy(*keys, "_bin").orderBy(value)
    values = binned.join(bins, [*keys, "_bin"]).withColumn("_upto", F.sum(n).over(within))
    return values.filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col(n) < F.col("_rank"))).select(*keys, value)


def funnel_report(rows: DataFrame, funnels: dict[str, tuple[tuple[str, ...], str | None]] = FUNNELS, client: str = "client_id", kind: str = "kind", at: str = "arrived_at", within: int = WITHIN, bucket: int = BUCKET, percent: int = 25) -> DataFrame:
    """funnel, client, n1.. (attempts that reach each step), deepest, t2.. (percentile of the time from the step before), same_depth."""
    specs = list(funnels.values())
    most = max(len(steps) for steps, _ in specs)
    base = rows.select(F.col(f"`{client}`").alias("_client"), F.col(f"`{kind}`").alias("_kind"), micros(rows, at).alias("_at")).dropna().distinct()
    steps = [F.struct(F.lit(1).alias("_step"), F.lit(0).cast("long").alias("_d"))]
    steps += [F.when(F.col(f"_d{k}").isNotNull(), F.struct(F.lit(k).alias("_step"), F.col(f"_d{k}").alias("_d"))) for k in range(2, most + 1)]
    reached = attempts(base, specs, within, bucket).select("_funnel", "_client", F.inline(F.array_compact(F.array(*steps))))
    counts = written(reached.groupBy("_funnel", "_client", "_step", "_d").agg(F.count("*").alias("_count")), "funnel-counts")
    depth = counts.groupBy("_funnel", "_client").agg(
        *[F.coalesce(F.sum(F.when(F.col("_step") == k, F.col("_count"))), F.lit(0)).alias(f"n{k}") for k in range(1, most + 1)], F.max("_step").alias("deepest")
    )
    times = ranked(counts.filter("_step > 1"), ["_funnel", "_client", "_step"], "_d", "_count", percent)
    times = times.groupBy("_funnel", "_client").agg(*[F.max(F.when(F.col("_step") == k, F.col("_d"))).alias(f"t{k}") for k in range(2, most + 1)])
    alike = depth.groupBy("_funnel", "deepest").agg(F.count("*").alias("same_depth"))  # at most a row for each funnel and step
    name = F.element_at(F.array(*[F.lit(x) for x in funnels]), F.col("_funnel")).alias("funnel")
    out = depth.join(times, ["_funnel", "_client"], "left").join(F.broadcast(alike), ["_funnel", "deepest"])
    return out.select(name, F.col("_client").alias(client), *[f"n{k}" for k in range(1, most + 1)], "deepest", *[f"t{k}" for k in range(2, most + 1)], "same_depth")
