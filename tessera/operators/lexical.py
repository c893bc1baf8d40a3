"""Lexical top-k over an index of postings in order of impact.

A posting's impact, ln(1 + tf) by the root of the unit's tokens, doesn't depend on the query, so the best postings of a term are known
before any task is. The index is two tables: postings, sorted by term, impact (falling) and unit and cut into blocks of BLOCK rows of one
term, and blocks with their best weight, least size and least unit. Both are read by any number of tasks.

A task's terms are taken from the rarest on. A unit is found by its rarest term there, so that its score is at most this posting's weight
(ln(1 + tf)) and the best weights of the more frequent terms, by the root of its own size. The units in each term's first blocks are scored
first, and give a score that k units reach: blocks, then postings, that can't beat it (nor, at an equal score, come first by unit) are left
out before they meet the task. The candidates that remain are scored in full. Nothing is approximate: bounds are rounded as scores are,
and are never too low.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import lexical_tokens

#: What lexical search reads of a unit, where it has it: short fields, never the content.
SEARCHED = ("title", "path", "name", "qualified_name", "signature")
BLOCK = 128
#: Sums in another order may differ by less than this.
NOISE = 1e-9


def searched_text(units: DataFrame) -> Column:
    return F.concat_ws(" ", *[F.col(c) for c in SEARCHED if c in units.columns])


def query_terms(tasks: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """task_id, term, distinct: of the prompt and, where evidence is given, of its messages. Texts of a task are never put together."""
    texts = tasks.select("task_id", F.col("prompt").alias("text"))
    if evidence is not None:
        texts = texts.unionByName(evidence.select("task_id", F.col("message").alias("text")).filter("text is not null").join(tasks.select("task_id"), "task_id", "left_semi"))
    return texts.select("task_id", F.explode(F.array_distinct(lexical_tokens(F.col("text")))).alias("term")).distinct()


def unit_terms(units: DataFrame) -> DataFrame:
    """unit_id, term, weight, size, impact."""
    words = units.select("unit_id", lexical_tokens(searched_text(units)).alias("tokens")).select("unit_id", F.size("tokens").alias("size"), F.explode("tokens").alias("term"))
    return words.groupBy("unit_id", "size", "term").agg(F.count(F.lit(1)).alias("tf")).select("unit_id", "term", F.log1p("tf").alias("weight"), "size", (F.log1p("tf") / F.sqrt("size")).alias("impact"))


def lexical_scores(tasks: DataFrame, units: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """task_id, unit_id, lexical_score of every pair that shares a term: the sum of the impacts of the task's distinct terms, 4 places."""
    scored = unit_terms(units).join(query_terms(tasks, evidence), "term").groupBy("task_id", "unit_id").agg(F.sum("impact").alias("s"))
    return scored.select("task_id", "unit_id", F.round("s", 4).alias("lexical_score")).filter("lexical_score > 0")


@dataclass(frozen=True)
class LexicalIndex:
    """postings: term, weight, size, impact, unit_id, block; blocks: term, block, rows, best, least_size, least_unit."""

    postings: DataFrame
    blocks: DataFrame
    block: int = BLOCK

    @staticmethod
    def build(units: DataFrame, folder: str, block: int = BLOCK) -> LexicalIndex:
        """Writes the index of units to a folder. Rows are sorted by ranges, so that a term of most units is not one task's work."""
        order = ["term", F.col("impact").desc(), "unit_id"]
        rows = unit_terms(units).repartitionByRange(*order).sortWithinPartitions(*order)
        rows.withColumn("block", F.floor(F.monotonically_increasing_id() / block)).write.option("compression", "zstd").parquet(f"{folder}/postings")
        blocks = units.sparkSession.read.parquet(f"{folder}/postings").groupBy("term", "block").agg(F.count(F.lit(1)).alias("rows"), F.max("weight").alias("best"), F.min("size").alias("least_size"), F.min("unit_id").alias("least_unit"))
        blocks.write.option("compression", "zstd").parquet(f"{folder}/blocks")
        return LexicalIndex.open(units.sparkSession, folder, block)

    @staticmethod
    def open(spark: SparkSession, folder: str, block: int = BLOCK) -> LexicalIndex:
        return LexicalIndex(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/blocks"), block)

    def _bounded(self, terms: DataFrame, k: int) -> DataFrame:
        """task_id, term, others (best weights of the task's more frequent terms), floor and floor_unit (the k-th of the first scores)."""
        known = self.blocks.groupBy("term").agg(F.sum("rows").alias("df"), F.max("best").alias("best"), F.min("block").alias("first"))
        asked = terms.join(known, "term")
        later = Window.partitionBy("task_id").orderBy("df", "term").rowsBetween(1, Window.unboundedFollowing)
        asked = asked.withColumn("others", F.coalesce(F.sum("best").over(later), F.lit(0.0)))
        # The first blocks of a term hold its best postings: blocks are numbered in their order, and a partition's are in a row.
        heads = known.select("term", F.explode(F.sequence("first", F.col("first") + F.lit(k // self.block + 1))).alias("block"))
        first = self.postings.join(heads.join(terms.select("term").distinct(), "term", "left_semi"), ["term", "block"]).select("term", "unit_id")
        seen = self.scores(first.join(terms, "term").select("task_id", "unit_id").distinct(), terms).withColumnRenamed("lexical_score", "floor")
        order = Window.partitionBy("task_id").orderBy(F.col("floor").desc(), "unit_id")
        kth = seen.withColumn("place", F.row_number().over(order)).filter(F.col("place") == k).select("task_id", "floor", F.col("unit_id").alias("floor_unit"))
        return asked.join(kth, "task_id", "left").select("task_id", "term", "others", "floor", "floor_unit")

    @staticmethod
    def _beats(weight: str, size: str, unit: str) -> Column:
        most = F.round((F.col(weight) + F.col("others")) / F.sqrt(size) + NOISE, 4)
        return F.col("floor").isNull() | (most > F.col("floor")) | ((most == F.col("floor")) & (F.col(unit) <= F.col("floor_unit")))

    def candidates(self, terms: DataFrame, k: int) -> DataFrame:
        """task_id, unit_id, distinct: the pairs that are scored; the best k of each task are among them."""
        blocks = self._bounded(terms, k).join(self.blocks, "term").filter(self._beats("best", "least_size", "least_unit"))
        return blocks.drop("rows", "best", "least_size", "least_unit").join(self.postings, ["term", "block"]).filter(self._beats("weight", "size", "unit_id")).select("task_id", "unit_id").distinct()

    def scores(self, pairs: DataFrame, terms: DataFrame) -> DataFrame:
        """task_id, unit_id, lexical_score of the given pairs, by all terms of the task."""
        own = self.postings.join(terms.select("term").distinct(), "term", "left_semi").select("unit_id", "term", "impact")
        return pairs.join(own, "unit_id").join(terms, ["task_id", "term"]).groupBy("task_id", "unit_id").agg(F.round(F.sum("impact"), 4).alias("lexical_score"))

    def top(self, terms: DataFrame, k: int) -> DataFrame:
        """task_id, unit_id, lexical_score, rank: the k best units of each task, equal scores in order of unit."""
        scored = self.scores(self.candidates(terms, k), terms)
        order = Window.partitionBy("task_id").orderBy(F.col("lexical_score").desc(), "unit_id")
        return scored.filter("lexical_score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
