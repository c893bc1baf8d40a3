"""Tables between the rounds of an iterative operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: A session's own setting: a folder below the shared one (see scratch), or in its stead in local mode.
OWN = "spark.tessera.folder"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one in local mode (one process does all), an error on a cluster."""
    where = spark.conf.get(OWN, None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(OWN, where)
    return where.rstrip("/")


def shared_uri(spark: SparkSession) -> str:
    """The shared folder with its scheme, as libraries outside Spark need it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    where = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + where[5:] if where.startswith("file:/") and not where.startswith("file://") else where


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/tessera/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame, tag: str) -> DataFrame:
    """df as a written table: it is computed once, and the plans of later rounds don't hold those of earlier ones."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own below the shared one for all tables that queries write within; it goes at the end, when their results have been read."""
    before, own = spark.conf.get(OWN, None), f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    spark.conf.set(OWN, own)
    try:
        yield own
    finally:
        spark.conf.unset(OWN) if before is None else spark.conf.set(OWN, before)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
