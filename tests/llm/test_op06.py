import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.llm import op06_mixing
from tessera.llm.op06_mixing import mix, mix_report, split_quotas

from .conftest import SCHEMA, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """The rule of the contract, round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        now = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in names if s not in capped and now[s] > 3 * sizes[s]}
        if not over:
            return now
        capped |= over


def check(rows, got):
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    want, taken = targets(size), Counter()
    assert len(got) == len(rows)
    source = defaultdict(set)
    for r in rows:
        source[r[0]].add(r[3])
    for g in got:
        assert 0 <= g["taken"] <= 3 * g["size"]
        (s,) = [x for x in source[g["doc_id"]] if size[x] == g["source_size"] and abs(want[x] - g["target"]) < 1e-6][:1]
        taken[s] += g["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) < 1


def test_targets_and_taken(spark, awkward):
    rows = [*awkward, *[(1000 + i, "one two", "en", "tiny") for i in range(3)], (2000, "", "en", "blank")]
    docs = frame(spark, rows)
    got = mix_report(docs, blocks=8).collect()
    check(rows, got)
    assert sorted(map(str, got)) == sorted(map(str, mix_report(docs.repartition(7), blocks=8).collect()))


def test_empty_blank_and_clashing(spark):
    assert mix_report(spark.createDataFrame([], SCHEMA)).collect() == []
    blank = mix_report(frame(spark, [(1, None, None, None), (2, " ", None, "a")])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)] * 2
    docs = frame(spark, [(i, "a b c", "en", f"s{i % 4}") for i in range(40)]).withColumns({c: F.lit(1) for c in ("size", "block", "turn", "words", "target")})
    assert mix_report(docs).count() == 40


def words_taken(rows, got):
    """Words of the mixture by id, source and text, cut ones as far as they are cut."""
    taken = Counter()
    for r in got:
        taken[r.row.doc_id, r.row.source, r.row.text] += len(WORD.findall(r.row.text)) if r.cut is None else r.cut
    return taken


def test_mixture_rows_follow_the_report(spark, awkward):
    rows = list({r[0]: r for r in awkward}.values())
    docs = frame(spark, rows)
    report = {r["doc_id"]: r["taken"] for r in mix_report(docs, blocks=8).collect()}
    got = mix(docs, shards=5, blocks=8).collect()
    taken = Counter()
    for (i, _, _), n in words_taken(rows, got).items():
        taken[i] += n
    assert {k: v for k, v in report.items() if v} == dict(taken)
    assert len({(r.row.doc_id, r.copy) for r in got}) == len(got) and {r["shard"] for r in got} <= set(range(5))


def test_repeated_rows_take_their_target(spark):
    """Equal rows are documents of their own: some are taken once more than others, and one in part."""
    rows = [*[(7, "a b c d", "en", "s")] * 6, (8, "x y z", "en", "s"), (9, "one two three", "en", "t")]
    got = mix_report(frame(spark, rows), blocks=1).collect()
    check(rows, got)
    for copies, other in ((40, 0), (1, 40), (17, 3)):
        rows = [*[(1, "a b c d e", "en", "s")] * copies, *[(2, "f g h", "en", "s")] * other, *[(i, "u v", "en", "t") for i in range(100, 140)]]
        for blocks in (1, 4):
            got = mix_report(frame(spark, rows), blocks=blocks).collect()
            check(rows, got)
            assert all(r.taken <= 3 * r["size"] for r in got)


def test_rows_that_differ_in_carried_columns_only(spark):
    """Rows of one id, source and text with other columns of their own: all of them are carried through, none stands for another."""
    docs = spark.createDataFrame([(1, "a b c", "z", f"tag{i}") for i in range(7)] + [(2, "x " * 30, "a", "other")], "doc_id long, text string, source string, row string")
    got = mix(docs, shards=3, blocks=1).collect()
    tags = Counter(r.row.row for r in got if r.row.doc_id == 1 and r.cut is None)
    report = sorted(r.taken for r in mix_report(docs, blocks=1).collect() if r.doc_id == 1)
    assert len(tags) == 7 and sum(tags.values()) * 3 + sum(r.cut for r in got if r.row.doc_id == 1 and r.cut) == sum(report)
    assert max(tags.values()) - min(tags.values()) <= 1 and report[-1] - report[0] <= 3
    again = mix(docs.repartition(5), shards=3, blocks=1).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def quotas_by_shard(spark, quotas, shards, seed):
    draws = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(f"={k}").alias("skey"), F.lit(n).alias("n")) for k, n in enumerate(quotas)])).alias("x")).select("x.*")
    draws = draws.filter("n > 0").select("skey", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("number"))
    got = Counter((r.shard, r.skey) for r in split_quotas(draws, shards, seed).collect())
    return [[got[s, f"={k}"] for k in range(len(quotas))] for s in range(shards)]


@pytest.mark.parametrize("shards", [1, 2, 5, 8])
def test_quotas_are_exact(spark, shards):
    quotas = [17, 0, 300, 4]
    parts = quotas_by_shard(spark, quotas, shards, 3)
    assert [sum(p[k] for p in parts) for k in range(4)] == quotas
    assert max(map(sum, parts)) - min(map(sum, parts)) <= len(bin(shards))


def test_splits_are_as_draws_without_replacement(spark):
    """The leaves of many trees, each with its own permutation: mean and variance of a side's count of a source."""
    draws = spark.range(3000).select(F.col("id").alias("tree"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("number"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.xxhash64("tree", "number"))) - 1
    left = [r.n for r in draws.withColumn("shard", op06_mixing._leaf(place, F.lit(40), 2)).groupBy("tree").agg(F.count_if((F.col("shard") == 0) & (F.col("number") >= 30)).alias("n")).collect()]
    mean = sum(left) / len(left)
    variance = sum((x - mean) ** 2 for x in left) / len(left)
    assert abs(mean - 5) < 0.12 and abs(variance - 20 * 0.25 * 0.75 * 20 / 39) < 0.25


@pytest.mark.parametrize("shards", [1, 3, 7, 5000])
def test_leaves_tile_the_draws(spark, shards):
    """Every node's left side has its share of the places, rounded down."""
    def deal(first, n, k):
        if k == 1:
            return [first] * n
        near = k // 2
        left = n * near // k
        return deal(first, left, near) + deal(first + near, n - left, k - near)

    got = spark.range(12_345).select("id", op06_mixing._leaf(F.col("id"), F.lit(12_345), shards).alias("shard")).orderBy("id").collect()
    assert [r.shard for r in got] == deal(0, 12_345, shards)


def test_many_sources_and_shards(spark):
    """More sources than blocks and as many shards: targets by the rule, every draw in one shard."""
    rng = random.Random(3)
    rows = [(i, "a b c " * rng.randrange(1, 9), "en", f"s{rng.randrange(700):03}") for i in range(2500)]
    got = mix_report(frame(spark, rows), blocks=4, shards=600).collect()
    check(rows, got)
    capped = {r.target == 3 * r.source_size for r in got if r.source_size}
    assert capped == {True, False}


def test_the_tree_decides_the_shards(spark, monkeypatch):
    """Each shard holds as many (block, pass) pairs of each source as its leaf of the tree says."""
    kept = []
    monkeypatch.setattr(op06_mixing, "split_quotas", lambda draws, shards, seed: kept.append(split_quotas(draws, shards, seed)) or kept[-1])
    rows = [(i, "a b c", "en", f"s{i % 3}") for i in range(400)]
    docs = frame(spark, rows)
    got = mix(docs, shards=6, blocks=16).collect()
    said = Counter((r.shard, r.skey) for r in kept[0].collect())
    block = {r.doc_id: (r.skey, r.block) for r in op06_mixing.sized(docs, 16, 11).collect()}
    held = defaultdict(set)
    for r in got:
        held[r.shard, block[r.row.doc_id][0]].add((block[r.row.doc_id][1], r.copy))
    assert {k: len(v) for k, v in held.items()} == dict(said)
    assert sum(map(len, held.values())) == len(set().union(*[{(k[1], *x) for x in v} for k, v in held.items()]))  # disjoint
    assert mix(docs, shards=6, blocks=16).rdd.getNumPartitions() == 6


def test_the_report_is_of_the_dealt_shards(spark, monkeypatch):
    called = []
    monkeypatch.setattr(op06_mixing, "split_quotas", lambda draws, shards, seed: called.append(shards) or split_quotas(draws, shards, seed))
    assert mix_report(frame(spark, [(1, "a b", "en", "s")]), blocks=8).count() == 1
    assert called == [4]
