import pytest
from pyspark.sql import functions as F

from tessera.llm.common import OWN, discarded, matched, sent, shared_dir, small_batches, table_bytes, written

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


class FakeSession:
    def __init__(self, master):
        self.held, self.conf = {"spark.master": master}, self

    def get(self, key, default=None):
        return self.held.get(key, default)


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            shared_dir(FakeSession(master))


def test_settings_come_back(spark):
    before = spark.conf.get(KEY)
    with pytest.raises(RuntimeError), small_batches(spark):
        assert spark.conf.get(KEY) == "4096"
        raise RuntimeError
    assert spark.conf.get(KEY) == before


def test_tables_are_sent_by_their_bytes(spark):
    rows = spark.createDataFrame([(i, "x" * i, [1] * i, None) for i in range(50)], "a long, s string, v array<long>, o struct<k:int>")
    n = table_bytes(rows)
    assert n == sum(8 + 8 + i + 8 + 8 * i + 8 + 8 + 8 for i in range(50)) + sum(len("{}") - 8 for _ in range(50))
    plan = lambda most: rows.join(sent(rows.select("a"), most), "a")._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(800) and "broadcast" not in plan(799)
    empty = rows.filter("a < 0")
    assert table_bytes(empty) == 0 and matched(rows, empty.select("a"), "a").collect() == []
    for most in (0, 10**6):
        assert matched(rows.select("a", "s"), rows.filter("a < 3").select("a", F.lit(1).alias("n")), ["a"], most).count() == 3


def test_tables_are_written_and_removed(spark):
    table = written(spark.range(5), "test")
    assert table.count() == 5
    discarded(table)
    with pytest.raises(Exception):
        spark.read.parquet(table._written_at)


def test_tables_go_below_the_sessions_own_folder(spark, tmp_path):
    own = f"file://{tmp_path}/own"
    spark.conf.set(OWN, own)
    try:
        table = written(spark.range(3).toDF("x"), "t")
        assert table._written_at.startswith(own) and table.count() == 3
    finally:
        spark.conf.unset(OWN)
    assert not shared_dir(spark).startswith(own)
