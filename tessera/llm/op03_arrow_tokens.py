"""Token ids in Arrow file format: fixed-size lists of ids and masks, for zero-copy random access to equal-length sequences.

Documents are dealt out by ranges of doc_id; each task writes one shard: `sequences-N.arrow` holds the shard's ids (each document's,
then the end id) cut into sequences of equal length, with a bit mask that is false only over the padding of the shard's last
sequence; `documents-N.arrow` holds doc_id, offset and length of each document in the shard. A shard is written under a name of its
attempt and then renamed, so a repeated or speculative task leaves one whole file.

Null text counts as empty (only the end id). A null doc_id sorts first; rows with equal doc_id are in order of a hash of their text. An empty
table gives no shards with documents and no rows. Other columns are ignored. A text of any length is encoded whole.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import new_folder, per_worker, small_batches
from tessera.llm.units import UnitTable, groups

#: White space before a space that isn't followed by a word: only there may a pre-token cross from one space-led unit into the next.
_CROSSING = "[\\s\\x1c-\\x1f\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0b] ([\\s\\x1c-\\x1f\\x0b\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]|$)"


class ByteLevelEncoder:
    """Encodes texts exactly as Tokenizer.encode(text, add_special_tokens=False) does.

    Byte-level pre-tokens begin at a space that leads a word, so a text's ids are those of its space-led units one after the other.
    Texts in which that doesn't hold (a space amid white space) are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        leads = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])  # the byte-level letter for a space
        self.table = UnitTable(lambda text: self._batch([text])[0], self._batch, leads, True, self.dtype)

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        odd = np.asarray(pc.match_substring_regex(texts, _CROSSING))
        ids, offsets = self.table.encode(texts.filter(pa.array(~odd)))
        k = 0
        for i in range(len(texts)):
            if odd[i]:
                yield np.array(self._batch([texts[i].as_py()])[0], dtype=self.dtype)
            else:
                yield ids[offsets[k] : offsets[k + 1]]
                k += 1


def sequence_schema(length: int, dtype: type) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


_INDEX = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


class ShardWriter:
    def __init__(self, folder: str, shard: int, length: int, dtype: type, rows: int = 512):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.length, self.dtype, self.rows, self.schema = length, dtype, rows, sequence_schema(length, dtype)
        self.names = [f"{root}/{kind}-{shard:06d}.arrow" for kind in ("sequences", "documents")]
        self.own = [f"{x}.{uuid.uuid4().hex}" for x in self.names]
        self.sinks = [self.fs.open_output_stream(x) for x in self.own]
        self.writers = [pa.ipc.new_file(s, x) for s, x in zip(self.sinks, (self.schema, _INDEX), strict=True)]
        self.pending: list[np.ndarray] = []
        self.waiting = self.tokens = self.documents = self.sequences = 0

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = np.ones(len(ids), dtype=bool)
        mask[real:] = False
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.writers[0].write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.sequences += len(ids) // self.length

    def add(self, doc_ids: pa.Array, encoded: list[np.ndarray]) -> None:
        lengths = np.array([len(x) for x in encoded], dtype=np.int64)
        offsets = self.tokens + np.cumsum(lengths) - lengths
        self.writers[1].write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(offsets), pa.array(lengths)], schema=_INDEX))
        self.tokens += int(lengths.sum())
        self.documents += len(encoded)
        self.pending += encoded
        self.waiting += int(lengths.sum())
        unit = self.rows * self.length
        if self.waiting >= unit:
            ids = np.concatenate(self.pending)
            for i in range(0, len(ids) // unit * unit, unit):
                self._put(ids[i : i + unit], unit)
            self.pending = [ids[len(ids) // unit * unit :]]
            self.waiting = len(self.pending[0])

    def close(self) -> None:
        ids = np.concatenate([np.zeros(0, self.dtype), *self.pending])
        if len(ids):
            self._put(np.concatenate([ids, np.zeros(-len(ids) % self.length, self.dtype)]), len(ids))
        for x in (*self.writers, *self.sinks):
            x.close()
        for a, b in zip(self.own, self.names, strict=True):
            self.fs.move(a, b)


def _write(path: str, folder: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, shard = per_worker(("byte-level", path), lambda: ByteLevelEncoder(path)), None, TaskContext.get().partitionId()
        end = np.array([end_id], dtype=encoder.dtype)
        for batch in batches:
            writer = writer or ShardWriter(folder, shard, length, encoder.dtype)
            texts = pc.fill_null(batch.column("text"), "")
            for i, j in groups(texts):
                writer.add(batch.column("doc_id")[i:j], [np.concatenate([x, end]) for x in encoder.encode(texts[i:j])])
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "documents": [writer.documents], "tokens": [writer.tokens], "sequences": [writer.sequences]}, schema=pa.schema([(x, pa.int64()) for x in ("shard", "documents", "tokens", "sequences")]))

    return run


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, length: int = 1024, end_id: int = 0, shards: int | None = None) -> list:
    """Writes docs (doc_id, text) as shards in folder; returns the manifest, a row for each shard in ascending order of doc_id."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = texts.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    with small_batches(spark):
        return sorted(dealt.mapInArrow(_write(tokenizer_path, folder, length, end_id), "shard long, documents long, tokens long, sequences long").collect())


def open_shard(folder: str, shard: int, kind: str) -> pa.ipc.RecordBatchFileReader:
    """Memory-mapped where the folder is a local one: reading a sequence then copies nothing."""
    system, root = pafs.FileSystem.from_uri(folder)
    name = f"{root}/{kind}-{shard:06d}.arrow"
    return pa.ipc.open_file(pa.memory_map(name) if isinstance(system, pafs.LocalFileSystem) else system.open_input_file(name))


def _read(folder: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist(), strict=True):
                sequences, index = open_shard(folder, shard, "sequences"), open_shard(folder, shard, "documents")
                held, begin, k = np.zeros(0, np.uint16), 0, 0  # the ids [begin, begin + len(held)) of the shard, and the next batch
                for j in range(index.num_record_batches):
                    docs = index.get_batch(j)
                    offsets, lengths, sums = docs.column("offset").to_pylist(), docs.column("n_tokens").to_pylist(), []
                    for offset, n in zip(offsets, lengths, strict=True):
                        while begin + len(held) < offset + n:
                            part = sequences.get_batch(k)
                            ids = np.asarray(part.column("ids").values)[np.asarray(part.column("mask").values.to_numpy(zero_copy_only=False))]
                            held, begin, k = np.concatenate([held[offset - begin :], ids]) if offset < begin + len(held) else ids, offset if offset < begin + len(held) else begin + len(held), k + 1
                        sums.append(zlib.crc32(held[offset - begin : offset - begin + n].astype("<u4").tobytes()))
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array([base + x for x in offsets], pa.int64()), docs.column("n_tokens"), pa.array(sums, pa.int64())], schema=schema)

    return run


def read_documents(spark, folder: str, manifest: list) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files that the manifest names."""
    rows, base = [], 0
    for x in manifest:
        rows.append((x["shard"], base))
        base += x["tokens"]
    parts = spark.createDataFrame(rows, "shard long, base long").repartition(max(1, len(rows)), "shard")
    return parts.mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer_path: str, length: int = 1024, folder: str | None = None) -> DataFrame:
    folder = folder or new_folder(docs.sparkSession, "token-shards")
    return read_documents(docs.sparkSession, folder, write_shards(docs, tokenizer_path, folder, length))
