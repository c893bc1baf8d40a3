"""Sharding by jump consistent hashing.

A row's shard follows from a 64-bit hash of its key columns and the number of shards alone: no ring, no table, no state. A key that one more
shard doesn't claim stays where it is, so that appending shards moves the share of rows that the new ones need, and moves rows into them
only (`moves`). The jumps are made for a batch of keys at a time by numpy.

`write_shards` deals whole rows: a folder of files for each shard. Rows are rebalanced by shard, so that a shard that is larger than the
session's advised partition size, by a hot key or otherwise, is split over tasks and files, and small ones share a task. `slots` numbers
the rows of each shard without gaps by file and place in it: files are counted, never rows of one shard in one task.

Equal keys share a shard, also null ones; equal texts meet only if their keys do. Repeated rows are rows of their own with slots of their
own. Null text has size 1 and the checksum of no bytes. An empty table gives no files and no rows. Columns of any name are kept; the
folders' label gets underscores before it until no column has its name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.llm.common import new_folder, sent

SHARDS = 8
LAW = "key"
#: Fixed value: the multiplier of the linear congruential step in the published algorithm.
STEP = 2862933555777941757


def jumped(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key: jumps forward from 0 while they land below the number of shards."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    at = np.zeros(len(keys), np.int64)
    going, state, here = np.arange(len(keys)), keys.astype(np.uint64), at.copy()
    while len(going):
        state = state * np.uint64(STEP) + np.uint64(1)
        there = ((here + 1) * (float(1 << 31) / ((state >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        on = there < shards
        going, state, here = going[on], state[on], there[on]
        at[going] = here
    return at


def shard_of(key: list[str], shards: int) -> Column:
    """The shard of a row by its key columns; the same in every session, however its data is partitioned."""

    @F.pandas_udf("int")
    def jumps(hashes: pd.Series) -> pd.Series:
        return pd.Series(jumped(hashes.to_numpy(np.int64).view(np.uint64), shards), dtype="int32")

    return jumps(F.xxhash64(*[F.col(f"`{k}`") for k in key]))


def label_of(columns: list[str]) -> str:
    label, taken = "shard", {c.lower() for c in columns}
    while label in taken:
        label = f"_{label}"
    return label


def write_shards(docs: DataFrame, folder: str, key: list[str], shards: int = SHARDS) -> str:
    """Writes all rows, sorted by key within a file, to a folder of files for each shard; returns the folders' label."""
    label = label_of(docs.columns)
    dealt = docs.withColumn(label, shard_of(key, shards)).hint("rebalance", label).sortWithinPartitions(label, *[F.col(f"`{k}`") for k in key])
    dealt.write.partitionBy(label).option("compression", "zstd").parquet(folder)
    return label


def read_shards(spark: SparkSession, folder: str, docs: DataFrame, label: str) -> DataFrame:
    return spark.read.schema(StructType([*docs.schema.fields, StructField(label, IntegerType())])).parquet(folder)


def slots(shards: DataFrame, label: str, kept: dict[str, Column]) -> DataFrame:
    """The columns of kept, `shard`, and `slot`: the row's number within its shard, from 0."""
    where = {"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")}
    files = shards.select(F.col(label).alias("shard"), where["_file"].alias("_file")).groupBy("shard", "_file").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("shard", "_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    rows = shards.select(*[c.alias(n) for n, c in kept.items()], F.col(label).alias("shard"), *[c.alias(n) for n, c in where.items()])
    return rows.join(sent(files), ["shard", "_file"]).select(*kept, "shard", (F.col("_before") + F.col("_row")).alias("slot"))


def moves(shards: DataFrame, label: str, key: list[str], more: int) -> DataFrame:
    """The rows that change their shard if there are `more` shards, with that shard as `<label>_to`; all others stay."""
    out = shards.withColumn(f"{label}_to", shard_of(key, more))
    return out.filter(F.col(f"{label}_to") != F.col(label))


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each document, from the files as read back."""
    spark, folder = docs.sparkSession, new_folder(docs.sparkSession, "shards")
    label = write_shards(docs, folder, ["doc_id"], shards)
    text = F.coalesce("text", F.lit("")).cast("binary")
    kept = {"doc_id": F.col("doc_id"), "size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text)}
    out = slots(read_shards(spark, folder, docs, label), label, kept)
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", shard_of(["doc_id"], shards + 1).alias("grown_shard"))
