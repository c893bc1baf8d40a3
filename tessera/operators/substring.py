"""Substring search over an index of grams, for many needles at once.

Lines are kept by file and part (PART lines). The index says which parts hold which three letters in a row. A needle is looked for in the
parts that hold all of its rarest grams, and its lines there are read and tested; nothing is found by the index alone, and nothing lost: a
part that lacks one gram of a needle can't hold the needle. Needles of under three letters have no gram, and are looked for in all lines.

A part's grams are found where the part is, in one pass over its text. In a search a part meets its needles as one row: its text moves once,
however many needles it may hold, and its lines are tested where they are. A search's needles, not the lines, are sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

GRAM = 3
PART = 64
#: Grams of a needle that choose its parts: the ones in the fewest parts.
RAREST = 4
PARTS = "unit_id long, part int, first int, texts array<string>"
#: A row holds the parts of a gram within a block of parts.
GRAMS = "gram string, held array<struct<unit_id: long, part: int>>"
BLOCK = 1024


def grams_of(text: Column) -> Column:
    """The distinct runs of GRAM letters; none of a shorter text."""
    places = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))))


def _runs(texts: list[str]) -> np.ndarray:
    """The distinct runs of GRAM letters within lines, as numbers: 21 bits a letter."""
    letters = np.frombuffer("\n".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    if len(letters) < GRAM:
        return letters[:0]
    runs = letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:]
    broken = letters == ord("\n")
    return np.unique(runs[~(broken[:-2] | broken[1:-1] | broken[2:])])


def _part_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """GRAMS of PARTS, a block of parts at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            block = batch.slice(start, BLOCK)
            runs = [_runs(texts) for texts in block.column("texts").to_pylist()]
            owner = np.repeat(np.arange(len(runs)), [len(x) for x in runs])
            order = np.argsort(every := np.concatenate(runs), kind="stable")
            grams, starts = np.unique(every[order], return_index=True)
            said = np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
            at = pa.array(owner[order])
            held = pa.StructArray.from_arrays([block.column("unit_id").take(at), block.column("part").take(at)], ["unit_id", "part"])
            offsets = pa.array(np.append(starts, len(every)), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([said[k : k + GRAM] for k in range(0, len(said), GRAM)], pa.string()), pa.ListArray.from_arrays(offsets, held)], ["gram", "held"])


@dataclass(frozen=True)
class LineIndex:
    """parts: unit_id, part, first (number of its first line, from 1), texts (of its lines); grams: gram, held (unit_id, part), each file sorted by gram."""

    parts: DataFrame
    grams: DataFrame

    @property
    def lines(self) -> DataFrame:
        """unit_id, line (from 1), text."""
        return self.parts.select("unit_id", "first", F.posexplode("texts").alias("at", "text")).select("unit_id", (F.col("first") + F.col("at")).alias("line"), "text")

    @staticmethod
    def build(units: DataFrame, folder: str, part: int = PART) -> LineIndex:
        """Writes the index of units (unit_id, content) to a folder."""
        lines = units.filter("content is not null").select("unit_id", F.split("content", "\n", -1).alias("l"))
        places = F.sequence(F.lit(0), F.floor((F.size("l") - 1) / part).cast("int"))
        cut = F.transform(places, lambda p: F.struct(p.alias("part"), (p * part + 1).alias("first"), F.slice("l", p * part + 1, part).alias("texts")))
        # Parts are dealt over all tasks, as the units may be one split.
        lines.select("unit_id", F.inline(cut)).repartition("unit_id", "part").write.option("compression", "zstd").parquet(f"{folder}/parts")
        held = units.sparkSession.read.schema(PARTS).parquet(f"{folder}/parts")
        held.mapInArrow(_part_grams, GRAMS).sortWithinPartitions("gram").write.option("compression", "zstd").parquet(f"{folder}/grams")
        return LineIndex.open(units.sparkSession, folder)

    @staticmethod
    def open(spark: SparkSession, folder: str) -> LineIndex:
        return LineIndex(spark.read.schema(PARTS).parquet(f"{folder}/parts"), spark.read.schema(GRAMS).parquet(f"{folder}/grams"))

    def _scan(self, needles: DataFrame, tested: bool) -> DataFrame:
        """needle_id, needle, unit_id, line, text of the lines that are tested, or (tested) of those that hold the needle, without the text."""
        needles = needles.filter("needle <> ''").select("needle_id", "needle")
        asked = needles.select("needle_id", "needle", F.explode(grams_of(F.col("needle"))).alias("gram"))
        often = self.grams.join(F.broadcast(asked.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.sum(F.size("held")).alias("n"))
        rarest = F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))), 1, RAREST)
        chosen = asked.join(often, "gram", "left").groupBy("needle_id", "needle").agg(F.transform(rarest, lambda x: x["gram"]).alias("grams"))
        short = needles.filter(F.length("needle") < GRAM).withColumn("grams", F.array().cast("array<string>"))  # of one or two letters
        known = [(r.needle_id, r.needle, frozenset(r.grams)) for r in chosen.unionByName(short).collect()]
        wanted = sorted({g for _, _, own in known for g in own})
        met = self.grams.filter(F.col("gram").isin(wanted)).select("gram", F.inline("held")).groupBy("unit_id", "part").agg(F.collect_list("gram").alias("met"))
        kinds = {"needle_id": needles.schema["needle_id"].dataType, "needle": T.StringType(), "unit_id": T.LongType(), "line": T.IntegerType(), "text": T.StringType()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for unit, first, texts, held in zip(*(batch.column(k).to_pylist() for k in ("unit_id", "first", "texts", "met")), strict=True):
                    grams, whole = frozenset(held or ()), "\n".join(texts)
                    may = [(k, x) for k, x, own in known if own <= grams and (not tested or x in whole)]
                    if tested:
                        out += [(k, x, unit, first + at, None) for at, text in enumerate(texts) for k, x in may if x in text]
                    else:
                        out += [(k, x, unit, first + at, text) for at, text in enumerate(texts) for k, x in may]
                yield pa.RecordBatch.from_arrays([pa.array(col, type_) for col, type_ in zip(zip(*out, strict=True) if out else [()] * len(arrow), arrow, strict=True)], list(kinds))

        arrow = [to_arrow_type(t) for t in kinds.values()]
        return self.parts.join(met, ["unit_id", "part"], "left").select("unit_id", "first", "texts", "met").mapInArrow(run, T.StructType([T.StructField(k, t) for k, t in kinds.items()]))

    def candidates(self, needles: DataFrame) -> DataFrame:
        """needle_id, needle, unit_id, line, text of the lines that are tested. needles: needle_id, needle."""
        return self._scan(needles, tested=False)

    def search(self, needles: DataFrame) -> DataFrame:
        """needle_id, unit_id, line: every line that contains the needle. An empty needle is found nowhere."""
        return self._scan(needles, tested=True).select("needle_id", "unit_id", "line")
