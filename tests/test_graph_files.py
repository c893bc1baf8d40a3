"""The graph's files are dealt over tasks before they are scanned."""

from pyspark.sql import functions as F

from tessera.plans.graph import graph_files


def test_files_made_of_one_small_table_are_many_tasks_work(spark):
    files = graph_files(spark, "/root/testdata/sf0.001").filter("kind = 'SOURCE_FILE'")
    assert files.select(F.spark_partition_id().alias("p")).distinct().count() >= 4
