"""Hash trees of snapshots: two snapshots are compared by going down where their hashes differ.

A file's place in the tree is the hash of its path, a hexadecimal digit a level, so that the tree is even whatever the folders are: a node has
sixteen children at most, and a leaf as many files as the depth leaves to it. A node's hash is taken over its children's in order. Changed
files are found by reading the nodes above them alone: levels are tables of their own, of which a comparison takes only the children of nodes
that differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 16
#: Files in a leaf, about.
LEAF = 16


def _joined(name: str, value: str) -> Column:
    """The hash over (name, value) pairs in order of name."""
    held = F.array_sort(F.collect_list(F.struct(name, value)))
    return F.sha2(F.array_join(F.transform(held, lambda x: F.concat_ws("=", x[name], x[value])), ";"), 256)


@dataclass(frozen=True)
class HashTree:
    """files: snapshot_id, path, content_hash, place; levels[k]: snapshot_id, place (k digits), node_hash."""

    files: DataFrame
    levels: list[DataFrame]

    @staticmethod
    def build(files: DataFrame, folder: str, expected: int) -> HashTree:
        """Writes the tree of files (snapshot_id, path, content_hash; a path once in a snapshot) to a folder, as deep as `expected` files of a snapshot ask for."""
        depth = 1
        while DIGITS**depth * LEAF < expected:
            depth += 1
        spark = files.sparkSession
        rows = files.select("snapshot_id", "path", "content_hash", F.left(F.sha2("path", 256), F.lit(depth)).alias("place"))
        rows.repartitionByRange("snapshot_id", "place").sortWithinPartitions("snapshot_id", "place").write.option("compression", "zstd").parquet(f"{folder}/files")
        below = spark.read.schema(rows.schema).parquet(f"{folder}/files").groupBy("snapshot_id", "place").agg(_joined("path", "content_hash").alias("node_hash"))
        for level in range(depth, -1, -1):
            below.sortWithinPartitions("snapshot_id", "place").write.option("compression", "zstd").parquet(f"{folder}/level-{level}")
            written = spark.read.schema(below.schema).parquet(f"{folder}/level-{level}")
            below = written.groupBy("snapshot_id", F.left("place", F.lit(level - 1)).alias("parent")).agg(_joined("place", "node_hash").alias("node_hash")).withColumnRenamed("parent", "place")
        return HashTree.open(spark, folder, depth)

    @staticmethod
    def open(spark: SparkSession, folder: str, depth: int) -> HashTree:
        return HashTree(spark.read.parquet(f"{folder}/files"), [spark.read.parquet(f"{folder}/level-{k}") for k in range(depth + 1)])

    def root_hashes(self) -> DataFrame:
        """snapshot_id, node_hash: equal for snapshots of equal files."""
        return self.levels[0].select("snapshot_id", "node_hash")

    def differing(self, pairs: DataFrame) -> list[DataFrame]:
        """For each level: old, new, place of the nodes that differ between the snapshots of a pair (old, new)."""
        out, above = [], pairs.select("old", "new", F.lit("").alias("place"))
        for level, nodes in enumerate(self.levels):
            sides = []
            for name in ("old", "new"):
                own = nodes.select(F.col("snapshot_id").alias(name), "place", F.left("place", F.lit(max(0, level - 1))).alias("parent"), F.col("node_hash").alias(f"{name}_hash"))
                sides.append(above.withColumnRenamed("place", "parent").join(own, [name, "parent"]).select("old", "new", "place", f"{name}_hash"))
            both = sides[0].join(sides[1], ["old", "new", "place"], "full")
            above = both.filter(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select("old", "new", "place")
            out.append(above)
        return out

    def changes(self, pairs: DataFrame) -> DataFrame:
        """old, new, path, change (ADDED, REMOVED or MODIFIED) of each file that differs between the snapshots of a pair."""
        leaves = self.differing(pairs)[-1]
        sides = [leaves.join(self.files.select(F.col("snapshot_id").alias(s), "place", "path", F.col("content_hash").alias(f"{s}_hash")), [s, "place"]).select("old", "new", "path", f"{s}_hash") for s in ("old", "new")]
        both = sides[0].join(sides[1], ["old", "new", "path"], "full").filter(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
        return both.select("old", "new", "path", F.when(F.col("old_hash").isNull(), "ADDED").when(F.col("new_hash").isNull(), "REMOVED").otherwise("MODIFIED").alias("change"))
