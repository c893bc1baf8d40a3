"""Exact dedup by content-defined chunk recipes.

Texts are cut at content-defined points; a chunk's identifier is its 64-bit hash, verified by comparing the bytes of all
chunks that share a hash with a chunk of another text (only those can make different texts look equal). Equal texts have equal
ordered lists of identifiers (recipes) and equal lengths, so only the short recipes take part in the comparison of documents; of the
texts' bytes only distinct chunks of recurring hashes move.

Null text counts as empty. Empty texts are equal. Repeated rows (also with the same doc_id) are members of their group; each row
with the largest doc_id stays. A null doc_id never is the largest unless all of a group are null. An empty table gives no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import mixed, sent, small_batches, text_groups, written

_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def cut_points(data: np.ndarray, offsets: np.ndarray, least: int, average_bits: int, most: int) -> list[list[int]]:
    """For each text the ends of its chunks. A cut depends on the 32 bytes before it, so equal content is cut alike at any place.

    least must be over 32: a candidate nearer to the text's start would also see the text before it.
    """
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):  # a gear hash of the last 32 bytes, by doubling
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    marks = np.flatnonzero(h >> np.uint32(32 - average_bits) == 0) + 1
    bounds = np.searchsorted(marks, offsets, "right")
    out = []
    for i in range(len(offsets) - 1):
        start, end = int(offsets[i]), int(offsets[i + 1])
        cuts, last = [], start
        if end - start > least:
            for m in marks[bounds[i] : bounds[i + 1]].tolist():
                while m - last > most:
                    last += most
                    cuts.append(last)
                if m - last >= least and m < end:
                    cuts.append(m)
                    last = m
            while end - last > most:
                last += most
                cuts.append(last)
        if end > start:
            cuts.append(end)
        out.append(cuts)
    return out


def _chunks(batch: pa.RecordBatch, opts: dict) -> Iterator[tuple[int, bytes, list[bytes]]]:
    for first, _, data, offsets in text_groups(batch):
        raw = data.tobytes()
        for i, cuts in enumerate(cut_points(data, offsets, opts["least"], opts["average_bits"], opts["most"])):
            start = int(offsets[i])
            yield first + i, raw[start : int(offsets[i + 1])], [raw[a:b] for a, b in zip([start, *cuts], cuts, strict=False)]


def _identifier(chunk: bytes, bits: int) -> int:
    h = xxhash.xxh64_intdigest(chunk) >> (64 - bits)
    return h - (1 << 64) if h >= 1 << 63 else h


def _recipes(opts: dict):
    schema = pa.schema([("doc_id", pa.int64()), ("recipe", pa.list_(pa.int64())), ("n_bytes", pa.int64()), ("text_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [([_identifier(c, opts["id_bits"]) for c in chunks], len(text), hashlib.sha256(text).hexdigest()) for _, text, chunks in _chunks(batch, opts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], schema.field(k + 1).type) for k in range(3))], schema=schema)

    return run


def _pieces(opts: dict):
    schema = pa.schema([("text_sha256", pa.string()), ("pos", pa.int32()), ("h", pa.int64()), ("chunk", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(hashlib.sha256(text).hexdigest() if opts["keyed"] else None, k, _identifier(c, opts["id_bits"]), c) for _, text, chunks in _chunks(batch, opts) for k, c in enumerate(chunks)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(4)], schema=schema)

    return run


def exact_groups(docs: DataFrame, least: int = 1024, average_bits: int = 12, most: int = 16384, id_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text).

    id_bits shortens the identifiers (tests force collisions with it); results don't depend on it.
    """
    with small_batches(docs.sparkSession):
        return _groups(docs, least, average_bits, most, id_bits)


def _groups(docs: DataFrame, least: int, average_bits: int, most: int, id_bits: int) -> DataFrame:
    opts = {"least": least, "average_bits": average_bits, "most": most, "id_bits": id_bits, "keyed": False}
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    recipes = written(texts.mapInArrow(_recipes(opts), "doc_id long, recipe array<long>, n_bytes long, text_sha256 string"), "recipes")
    piece_schema = "text_sha256 string, pos int, h long, chunk binary"
    hashes = recipes.dropDuplicates(["text_sha256"]).select(F.explode(F.array_distinct("recipe")).alias("h"))
    recurring = written(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "recurring-hashes")
    # Equal pairs of identifier and bytes meet in each task first, so a frequent chunk moves once a task.
    pieces = texts.mapInArrow(_pieces(opts), piece_schema).join(sent(recurring), "h", "left_semi")
    distinct = pieces.groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("n"))
    collided = written(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1").select("h"), "collided")
    key = ["recipe", "n_bytes"]
    if not collided.isEmpty():
        pieces = texts.mapInArrow(_pieces(opts | {"keyed": True}), piece_schema).join(sent(collided), "h", "left_semi").dropDuplicates(["text_sha256", "pos"])
        variant = pieces.select("h", "chunk").distinct().withColumn("variant", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
        marks = pieces.join(variant, ["h", "chunk"]).groupBy("text_sha256").agg(F.array_sort(F.collect_list(F.struct("pos", "variant"))).alias("variants"))
        recipes = recipes.join(marks, "text_sha256", "left").withColumn("variants", F.coalesce("variants", F.array().cast("array<struct<pos:int,variant:int>>")))
        key = [*key, "variants"]
    # Written, so that both sides of the join are dealt out anew and a large group's rows can be split over tasks.
    groups = written(recipes.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return recipes.join(groups, key).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
