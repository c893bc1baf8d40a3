"""Point-in-time operators over commits (sha, ts, file)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import settled


def until(df: DataFrame, cutoff: str, column: str = "ts") -> DataFrame:
    """Rows not later than the cutoff, which counts."""
    return df.filter(F.col(column) <= F.lit(cutoff).cast("timestamp"))


def latest_commits(commits: DataFrame, cutoff: str, n: int = 500) -> DataFrame:
    return until(commits, cutoff).orderBy(F.col("ts").desc(), "sha").limit(n)


def epoch_to_timestamp(number):
    """Numbers under 1e10 are seconds, others milliseconds."""
    return F.when(number < 10_000_000_000, F.timestamp_seconds(number)).otherwise(F.timestamp_millis(number))


def change_frequency(files: DataFrame, cutoff: str, days: int = 30) -> DataFrame:
    """file, changes, recent_changes (in the window of days that ends with the cutoff; both ends count)."""
    at = F.lit(cutoff).cast("timestamp")
    recent = F.when(F.col("ts") >= at - F.expr(f"INTERVAL {days} DAYS"), F.col("sha"))
    return until(files, cutoff).groupBy("file").agg(F.count_distinct("sha").alias("changes"), F.count_distinct(recent).alias("recent_changes"))


#: Files of a commit that are paired at a time; larger commits are cut into chunks, whose pairs are units of work of their own.
CHUNK = 256


#: Pairs that are made at a time in a task.
PAIRS = 1 << 22


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, other, shared of a batch of commits (held: their files in order): commits with equally many files are paired at once, and each pair is
    counted before it leaves."""
    for batch in batches:
        held = batch.column("held")
        names = held.flatten().dictionary_encode()
        codes, n = np.asarray(names.indices), len(names.dictionary)
        sizes = np.asarray(held.value_lengths())
        starts = np.cumsum(sizes) - sizes
        for size in np.unique(sizes[sizes > 1]):
            i, j = np.triu_indices(size, 1)
            own, step = starts[sizes == size], max(1, PAIRS // len(i))
            for at in range(0, len(own), step):
                rows = codes[own[at : at + step, None] + np.arange(size)].astype(np.int64)
                pairs, shared = np.unique(rows[:, i] * n + rows[:, j], return_counts=True)
                yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(pairs // n)), names.dictionary.take(pa.array(pairs % n)), pa.array(shared, pa.int64())], ["file", "other", "shared"])


def _parts(files: DataFrame, chunk: int) -> DataFrame:
    """sha, part, held: each commit's distinct files in order, at most chunk at a time."""
    place = F.row_number().over(Window.partitionBy("sha").orderBy("file")) - 1
    parts = files.select("sha", "file").distinct().withColumn("part", F.floor(place / chunk).cast("int"))
    return settled(parts.groupBy("sha", "part").agg(F.sort_array(F.collect_list("file")).alias("held")), "commit-files")


def _undirected(parts: DataFrame) -> DataFrame:
    """file, other, shared for file < other: pairs come from arrays of at most a chunk of files, so no commit is one task's."""
    file = parts.schema["held"].dataType.elementType.simpleString()
    within = parts.select("held").mapInArrow(_paired, f"file {file}, other {file}, shared long")
    several = parts.filter("part > 0").select("sha").distinct()
    big = parts.join(several, "sha", "left_semi")
    a, b = big.select("sha", F.col("part").alias("p"), F.col("held").alias("x")), big.select("sha", F.col("part").alias("q"), F.col("held").alias("y"))
    across = a.join(b, "sha").filter("p < q").repartition("sha", "p", "q")
    across = across.select(F.inline(F.flatten(F.transform("x", lambda m: F.transform("y", lambda n: F.struct(m.alias("file"), n.alias("other")))))), F.lit(1).cast("long").alias("shared"))
    return within.unionByName(across).groupBy("file", "other").agg(F.sum("shared").alias("shared"))


def _directed(pairs: DataFrame) -> DataFrame:
    return pairs.select("shared", F.explode(F.array(F.struct("file", "other"), F.struct(F.col("other").alias("file"), F.col("file").alias("other")))).alias("x")).select("x.file", "x.other", "shared")


def co_changes(files: DataFrame, least_shared: int = 1, chunk: int = CHUNK) -> DataFrame:
    """file, other, shared: directed pairs of files in a commit, with the number of commits (at least least_shared)."""
    return _directed(_undirected(_parts(files, chunk)).filter(F.col("shared") >= least_shared))


def co_change_scores(files: DataFrame, cutoff: str, least_shared: int = 3, least_score: float = 0.15) -> DataFrame:
    """file, other, shared, score: shared commits by the commits of file."""
    parts = _parts(until(files, cutoff), CHUNK)
    totals = parts.select("sha", F.explode("held").alias("file")).groupBy("file").agg(F.count("sha").alias("total"))
    scored = _directed(_undirected(parts).filter(F.col("shared") >= least_shared)).join(totals, "file").withColumn("score", F.col("shared") / F.col("total"))
    return scored.filter(F.col("score") >= least_score)


def directional_co_change(files: DataFrame, pairs: DataFrame, cutoff: str) -> DataFrame:
    """score of given pairs (a, b): 1 for a file with itself, 0 if a never changes, else the share of a's commits that touch b."""
    known = until(files, cutoff).select("sha", "file")
    totals = known.groupBy(F.col("file").alias("a")).agg(F.count(F.lit(1)).alias("total"))
    both = pairs.join(known.withColumnRenamed("file", "a"), "a").join(known.withColumnRenamed("file", "b"), ["sha", "b"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    score = F.when(F.col("a") == F.col("b"), 1.0).when(F.col("total").isNull(), 0.0).otherwise(F.coalesce("both", F.lit(0)) / F.col("total"))
    return pairs.join(totals, "a", "left").join(both, ["a", "b"], "left").select("a", "b", score.alias("score"))


def expand_by_co_change(seeds: DataFrame, scores: DataFrame) -> DataFrame:
    """task_id, unit_id, co_change_score: partners of each task's seed files, with their best score."""
    return seeds.join(scores, "file").groupBy("task_id", F.col("other").alias("unit_id")).agg(F.max("score").alias("co_change_score"))
