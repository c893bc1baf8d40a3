"""Ancestry in rounds that double: each row points to an ancestor twice as far as in the round before."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import settled


def roots(parents: DataFrame) -> DataFrame:
    """id, root, depth, cyclic of each row of parents (id, parent): the last ancestor that is there, and the steps to it.

    A parent that is null, or isn't among the ids, ends a chain. Rows that are in a cycle, or lead into one, have neither root nor depth: after
    as many rounds as the number of rows has binary digits, any chain without a cycle has ended. Rows whose chain has ended meet nothing any more.
    """
    ids = parents.select(F.col("id").alias("parent")).distinct()
    known = parents.select("id", "parent").filter("parent is not null").join(ids, "parent", "left_semi").select("id", F.col("parent").alias("at"), F.lit(1).cast("long").alias("depth"))
    state = settled(parents.select("id").join(known, "id", "left").select("id", F.coalesce("at", "id").alias("at"), F.coalesce("depth", F.lit(0)).alias("depth")), "ancestors")
    ended = [state.filter("depth = 0").select("id", F.col("id").alias("root"), "depth")]
    going = state.filter("depth > 0")
    for _ in range(math.ceil(math.log2(max(2, state.count()))) + 1):
        # What an id points to this round: those whose chain has ended point to their root.
        further = going.unionByName(_all(ended).select("id", F.col("root").alias("at"), "depth")).select(F.col("id").alias("at"), F.col("at").alias("further"), F.col("depth").alias("more"))
        last = _all(ended).select(F.col("id").alias("at"), F.lit(True).alias("last"))
        step = going.join(further, "at").join(last, "at", "left").select("id", F.col("further").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.coalesce("last", F.lit(False)).alias("last"))
        step = settled(step, "ancestors")
        ended.append(step.filter("last").select("id", F.col("at").alias("root"), "depth"))
        going = step.filter("not last").drop("last")
        if going.isEmpty():
            break
    lost = going.select("id", F.lit(None).cast(going.schema["id"].dataType).alias("root"), F.lit(None).cast("long").alias("depth"), F.lit(True).alias("cyclic"))
    return _all(ended).withColumn("cyclic", F.lit(False)).unionByName(lost)


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
