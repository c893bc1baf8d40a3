import math
import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.llm.op11_funnels import FUNNELS, funnel_report, ranked

SCHEMA = "click_id long, client_id long, kind string, arrived_at timestamp_ntz"
START = datetime(2024, 3, 31, 1, 0)


def brute(rows, funnels=FUNNELS, within=timedelta(minutes=5)):
    by_client = {}
    for _, client, kind, at in rows:
        if None not in (client, kind, at):
            by_client.setdefault(client, {}).setdefault(kind, set()).add(at)
    out = {}
    for name, (steps, barred) in funnels.items():
        for client, kinds in by_client.items():
            tries = []
            for t1 in kinds.get(steps[0], ()):
                times, d = [t1], []
                for k in steps[1:]:
                    after = [t for t in kinds.get(k, ()) if t > times[-1]]
                    if not after or min(after) > t1 + within or any(times[-1] < x <= min(after) for x in kinds.get(barred, ())):
                        break
                    d.append((min(after) - times[-1]) // timedelta(microseconds=1))
                    times.append(min(after))
                tries.append(d)
            if tries:
                n = [sum(len(d) >= k for d in tries) for k in range(len(steps))]
                t = [sorted(d[k] for d in tries if len(d) > k)[math.ceil(25 * n[k + 1] / 100) - 1] if n[k + 1] else None for k in range(len(steps) - 1)]
                out[name, client] = (*n, max(map(len, tries)) + 1, *t)
    depths = Counter((name, x[len(funnels[name][0])]) for (name, _), x in out.items())
    return sorted((name, client, *x, depths[name, x[len(funnels[name][0])]]) for (name, client), x in out.items())


def clicks(seed, n, clients, resolution):
    rng = random.Random(seed)
    kinds, rows = ["view"] * 5 + ["click"] * 4 + ["purchase"] * 2 + ["signup", "error"], []
    for i in range(n):
        client = 0 if rng.random() < 0.4 else rng.randrange(clients)
        at = START + timedelta(microseconds=rng.randrange(0, 7_200_000_000 // resolution) * resolution)
        rows.append((i, client, rng.choice(kinds), at))
    rows += rng.sample(rows, n // 10)
    rows += [(n, None, "view", START), (n, 1, None, START), (n, 1, "view", None), (n, 99, "purchase", START)]
    return rows


def got(spark, rows, **more):
    return sorted(map(tuple, funnel_report(spark.createDataFrame(rows, SCHEMA), **more).collect()))


def test_against_brute_force(spark):
    for seed, resolution in ((1, 1_000_000), (2, 1), (3, 30_000_000)):
        rows = clicks(seed, 1500, 12, resolution)
        assert got(spark, rows) == brute(rows)
    assert got(spark, rows, bucket=300_000_000) == brute(rows)


def test_ties_limits_and_exclusion(spark):
    def at(s):
        return START + timedelta(seconds=s)

    same = [(0, 1, "view", at(0)), (1, 1, "click", at(0)), (2, 1, "view", at(0))]  # a click of the same time doesn't follow
    edge = [(3, 2, "view", at(0)), (4, 2, "click", at(300)), (5, 3, "view", at(0)), (6, 3, "click", at(300) + timedelta(microseconds=1))]
    barred = [(7, 4, "view", at(0)), (8, 4, "error", at(10)), (9, 4, "click", at(10)), (10, 5, "view", at(0)), (11, 5, "error", at(0)), (12, 5, "click", at(10))]
    rows = same + edge + barred
    assert got(spark, rows) == brute(rows)
    n2 = {r[1]: r[3] for r in got(spark, rows) if r[0] == "A"}
    assert n2 == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}


def test_attempts_that_cross_stretches_of_time_and_daylight_saving(spark):
    edge = datetime(2024, 3, 31, 2, 30)
    rows = [(i, 1, k, edge + timedelta(seconds=s)) for i, (k, s) in enumerate((("view", -200), ("click", -1), ("view", 0), ("purchase", 99), ("error", 120)))]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert got(spark, rows) == brute(rows) and got(spark, rows)[0][2:7] == (2, 1, 1, 1, 4)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_empty_table_other_columns_and_zoned_times(spark):
    assert got(spark, []) == []
    rows = clicks(4, 300, 5, 1_000_000)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("_at", "_client", "_bucket", "_funnel", "funnel", "n1", "t2", "_kind")})
    assert sorted(map(tuple, funnel_report(df).collect())) == brute(rows)
    assert sorted(map(tuple, funnel_report(df.withColumn("arrived_at", F.col("arrived_at").cast("timestamp"))).collect())) == brute(rows)


def test_funnels_of_other_lengths(spark):
    rows = clicks(5, 400, 5, 1_000_000)
    own = {"long": (("view", "click", "click", "view", "purchase"), None), "short": (("click", "view"), "purchase")}
    want = {(r[0], r[1]): r for r in brute(rows, own)}
    for r in funnel_report(spark.createDataFrame(rows, SCHEMA), own).collect():
        w = want[r.funnel, r.client_id]
        k = len(own[r.funnel][0])
        assert [r[f"n{i}"] for i in range(1, k + 1)] == list(w[2 : 2 + k]) and r.deepest == w[2 + k] and [r[f"t{i}"] for i in range(2, k + 1)] == list(w[3 + k : 2 + 2 * k])
    assert len(want) == len({x for x in want})


def test_ranks_by_bins(spark):
    rng = random.Random(6)
    values = [(k, rng.randrange(0, 10**7) if k else rng.randrange(3)) for k in (0, 1) for _ in range(500)]
    counts = spark.createDataFrame(values, "k int, v long").groupBy("k", "v").agg(F.count("*").alias("n"))
    for percent in (1, 25, 50, 100):
        out = dict(map(tuple, ranked(counts, ["k"], "v", "n", percent, 1000).collect()))
        assert out == {k: sorted(v for x, v in values if x == k)[math.ceil(percent * 500 / 100) - 1] for k in (0, 1)}
