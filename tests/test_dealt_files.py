"""Files that are made of the part table are dealt over tasks before they are made, written or scanned."""

from pyspark.sql import functions as F

from tessera.plans import scans

FOLDER = "/root/testdata/sf0.001"


def test_code_files_are_many_tasks_work(spark):
    assert scans.code_files(spark, FOLDER).select(F.spark_partition_id().alias("p")).distinct().count() >= 4


def test_written_files_are_many_tasks_work(spark, monkeypatch):
    tasks = []
    monkeypatch.setattr(scans, "written_files", lambda files, root, f=scans.written_files: tasks.append(files.rdd.getNumPartitions()) or f(files, root))
    assert scans.s01_repository_scan(spark, FOLDER).count() > 0 and tasks[0] >= 4
