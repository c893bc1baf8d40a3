import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.common import new_folder
from tessera.llm.op12_jump_shards import jumped, moves, read_shards, shard_of, shard_report, slots, write_shards

from .conftest import SCHEMA, frame


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def held(rows, got, shards=8):
    """Every row once, with its size and checksum; shards and growth by the key alone; slots without gaps."""
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    where = {}
    for r in got:
        assert where.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard) and 0 <= r.shard < shards
        assert r.grown_shard in (r.shard, shards) and r.law == "key"
    for s in range(shards):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    return where


def test_jumps_are_those_of_the_published_loop():
    rng = random.Random(1)
    keys = [rng.randrange(2**64) for _ in range(400)] + [0, 1, 2**64 - 1]
    for shards in (1, 2, 7, 8, 9, 1000):
        assert jumped(np.array(keys, np.uint64), shards).tolist() == [jump(k, shards) for k in keys]
    assert jumped(np.zeros(0, np.uint64), 8).tolist() == []


def test_shares_are_even_and_growth_moves_what_it_must():
    keys = np.random.default_rng(2).integers(0, 2**63, 80_000).astype(np.uint64)
    eight, nine, twelve = (jumped(keys, n) for n in (8, 9, 12))
    assert np.bincount(eight).min() > 9_600 and np.bincount(eight).max() < 10_400
    assert set(nine[eight != nine]) == {8} and abs((eight != nine).mean() - 1 / 9) < 0.01
    assert set(twelve[eight != twelve]) == {8, 9, 10, 11} and abs((eight != twelve).mean() - 4 / 12) < 0.01


def test_awkward_rows(spark, awkward):
    got = shard_report(frame(spark, awkward)).collect()
    where = held(awkward, got)
    again = {r.doc_id: (r.shard, r.grown_shard) for r in shard_report(frame(spark, awkward[::-1]).repartition(7)).collect()}
    assert where == again and len(got) == len(awkward) and len({s for s, _ in where.values()}) == 8


def test_hot_key_is_split_over_files(spark):
    rng = random.Random(3)
    rows = [(7, f"{i} {rng.randbytes(500).hex()}", "en", "s") for i in range(2000)] + [(i, "cold", "en", "s") for i in range(100, 400)]
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
        docs, folder = frame(spark, rows).repartition(8), new_folder(spark, "test-shards")
        label = write_shards(docs, folder, ["doc_id"])
        table = read_shards(spark, folder, docs, label)
        files = table.filter("doc_id = 7").groupBy(F.col("_metadata.file_path")).count().collect()
        assert len(files) > 2 and sum(r["count"] for r in files) == 2000
        held(rows, shard_report(docs).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)


def test_empty_table_and_clashing_columns(spark, awkward):
    assert shard_report(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = frame(spark, awkward).withColumns({c: F.lit(c) for c in ("shard", "_SHARD", "slot", "size", "_file", "_rows", "law", "_before")})
    held(awkward, shard_report(docs).collect())
    folder = new_folder(spark, "test-shards")
    label = write_shards(docs, folder, ["doc_id"])
    table = read_shards(spark, folder, docs, label)
    assert label == "__shard" and Counter(map(str, table.drop(label).collect())) == Counter(map(str, docs.collect()))


def test_moves_and_keys_of_several_columns(spark):
    docs = frame(spark, [(i // 2, f"t{i}", None if i % 3 else "en", f"s{i % 5}") for i in range(2000)])
    folder, key = new_folder(spark, "test-shards"), ["source", "lang", "doc_id"]
    table = read_shards(spark, folder, docs, write_shards(docs, folder, key, 4))
    moved = moves(table, "shard", key, 6).collect()
    now = table.withColumn("now", shard_of(key, 6)).collect()
    assert {r.text for r in moved} == {r.text for r in now if r.now != r.shard} and all(r.shard_to in (4, 5) for r in moved)
    assert 0.25 < len(moved) / 2000 < 0.42
    got = slots(table, "shard", {"text": F.col("text")}).collect()
    assert len({(r.shard, r.slot) for r in got}) == len({r.text for r in got}) == 2000
