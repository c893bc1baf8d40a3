"""The keyed table: what a change writes, null keys, several writers, replays, compaction."""

import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tessera.sources.sinks import KeyedTable

SCHEMA = "k long, l string, v string"


def order():
    return [F.col("v").desc()]


def table(spark, tmp_path, name="t"):
    return KeyedTable(spark, f"file://{tmp_path}/{name}", ["k", "l"], SCHEMA)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(keyed):
    rows = keyed.rows().collect()
    out = {(r.k, r.l): r.v for r in rows}
    assert len(out) == len(rows)
    return out


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_random_changes_against_a_dict(spark, tmp_path):
    rng, keyed, want = random.Random(1), table(spark, tmp_path), {}
    key = lambda: (rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "", "a"]))
    for step in range(8):
        if step % 3 == 2:
            gone = {key() for _ in range(3)}
            assert keyed.delete(spark.createDataFrame(list(gone), "k long, l string")) == len(gone & set(want))
            want = {k: v for k, v in want.items() if k not in gone}
        else:
            rows = [(*key(), f"{step}-{i}") for i in range(4)]
            keyed.upsert(frame(spark, rows), order())
            want |= {(k, l): v for k, l, v in rows}
        if step == 4:
            keyed.compact()
        assert held(keyed) == want
    keyed.compact()
    keyed.vacuum()
    assert held(keyed) == want and len(keyed.log()) == 1 and len([f for f in os.listdir(f"{tmp_path}/t") if f.startswith("data-")]) == 1


def test_a_null_key_is_a_key_like_any_other(spark, tmp_path):
    keyed = table(spark, tmp_path)
    keyed.upsert(frame(spark, [(None, None, "a"), (None, None, "b"), (None, "x", "c")]), order())
    keyed.upsert(frame(spark, [(None, None, "d")]), order())
    assert held(keyed) == {(None, None): "d", (None, "x"): "c"}
    assert keyed.delete(spark.createDataFrame([(None, None)], "k long, l string")) == 1 and held(keyed) == {(None, "x"): "c"}


def test_an_upsert_of_one_in_a_hundred_writes_little(spark, tmp_path):
    keyed = table(spark, tmp_path)
    text = F.sha2(F.concat(F.col("id").cast("string"), F.lit("x")), 256)
    keyed.upsert(spark.range(100_000).select(F.col("id").alias("k"), F.lit("a").alias("l"), text.alias("v")), order())
    before = size(tmp_path)
    keyed.upsert(spark.range(0, 100_000, 100).select(F.col("id").alias("k"), F.lit("a").alias("l"), F.sha2(text, 256).alias("v")), order())
    assert size(tmp_path) - before < 0.02 * before
    assert keyed.rows().count() == 100_000


def test_two_writers_lose_no_change(spark, tmp_path):
    def write(who):
        keyed = table(spark, tmp_path)
        for i in range(6):
            keyed.upsert(frame(spark, [(who * 100 + i, "a", "own"), (7, "both", f"{who}-{i}")]), order())

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    keyed = table(spark, tmp_path)
    assert [x["number"] for x in keyed.log()] == list(range(1, 19))
    out = held(keyed)
    assert {k for k, l in out if l == "a"} == {w * 100 + i for w in range(3) for i in range(6)} and out[7, "both"].endswith("-5")


def test_changes_during_a_compaction_lie_over_it(spark, tmp_path, monkeypatch):
    keyed, other = table(spark, tmp_path), table(spark, tmp_path)
    keyed.upsert(frame(spark, [(1, "a", "old"), (2, "a", "old")]), order())
    publish = keyed._publish

    def late(entry):
        other.upsert(frame(spark, [(1, "a", "new")]), order())
        return publish(entry)

    monkeypatch.setattr(keyed, "_publish", late)
    keyed.compact()
    assert [x["base"] for x in keyed.log()] == [False, False, True] and held(other) == {(1, "a"): "new", (2, "a"): "old"}
    other.vacuum()
    assert held(other) == {(1, "a"): "new", (2, "a"): "old"}


def test_replays_and_failures(spark, tmp_path, monkeypatch):
    keyed = table(spark, tmp_path)
    for batch in (("s", 0), ("s", 0), ("t", 0), ("s", 1), ("s", 0)):
        keyed.upsert(frame(spark, [(1, "a", f"{batch[0]}{batch[1]}")]), order(), batch=batch)
    assert len(keyed.log()) == 3 and held(keyed) == {(1, "a"): "s1"}
    with pytest.raises(Exception):
        keyed.upsert(frame(spark, [(1, "a", "x")]).withColumn("v", F.raise_error(F.lit("no"))), order())
    assert held(keyed) == {(1, "a"): "s1"}
    monkeypatch.setattr(KeyedTable, "CHANGES", 3)
    keyed.upsert(frame(spark, [(2, "a", "y")]), order(), batch=("s", 2))
    assert keyed.log()[-1]["base"] and keyed.log()[-1]["streams"] == {"s": 2, "t": 0}
    keyed.vacuum()
    keyed.upsert(frame(spark, [(2, "a", "again")]), order(), batch=("s", 2))
    assert held(keyed) == {(1, "a"): "s1", (2, "a"): "y"}
