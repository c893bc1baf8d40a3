"""SentencePiece encoding and decoding with distinct-word tables.

The model's pieces hold the white-space mark only at their front, so no merge crosses from one marked word into the next: each
distinct marked word is segmented once a table, and ids are joined back by position. The table is each task's own, with a bounded
number of words (those of units.GROUP_BYTES of text), so nothing is shuffled and a lost task is simply run again. Texts in which a marked word is
not well defined (spaces at an end or one after another, or the mark itself in the text) are encoded whole. The mark rule is checked
against the model's pieces when the encoder is opened; with a model that breaks it every text is encoded whole.

Null text counts as empty and gives the end id alone. Other columns don't matter; repeated rows and null doc_ids give a row each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import per_worker, small_batches, written
from tessera.llm.units import UnitTable, groups

MARK = "▁"
_ODD = f"^ |  | $|{MARK}"


class PieceEncoder:
    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.whole = any(re.search(f"[^{MARK}]{MARK}", x) for x in pieces) or self.model.encode("a b", out_type=str)[:1] != [f"{MARK}a"]
        self.end = self.model.eos_id()
        leads = np.array([x.startswith(MARK) for x in pieces])
        self.table = UnitTable(self.model.encode, lambda texts: self.model.encode(texts, num_threads=1), leads, False, np.int32)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text, with the end id."""
        odd = np.asarray(pc.match_substring_regex(texts, _ODD))
        if self.whole:
            odd = np.ones(len(texts), dtype=bool)
        ids, offsets = self.table.encode(texts.filter(pa.array(~odd)))
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = np.diff(offsets)
        own = [np.array(x, np.int32) for x in self.model.encode(texts.filter(pa.array(odd)).to_pylist(), num_threads=1)] if odd.any() else []
        counts[odd] = [len(x) for x in own]
        ends = np.cumsum(counts + 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, self.end, dtype=np.int32)
        body = np.ones(len(out), dtype=bool)
        body[ends - 1] = False
        of_odd = np.repeat(odd, counts + 1) & body
        out[of_odd] = np.concatenate([np.zeros(0, np.int32), *own])
        out[body & ~of_odd] = ids
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out))


def _digest(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("pieces", path), lambda: PieceEncoder(path))
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for i, j in groups(texts):
                ids = encoder.encode(texts[i:j])
                decimal = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, pc.cast(ids.values, pa.string())), " ")
                ends, values = np.asarray(ids.offsets).tolist(), np.asarray(ids.values)
                rows = [(hashlib.sha256(d.as_buffer()).hexdigest(), hashlib.sha256(encoder.model.decode(values[a:b].tolist()).encode()).hexdigest()) for d, a, b in zip(decimal, ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pc.cast(pc.list_value_length(ids), pa.int64()), *(pa.array([r[k] for r in rows], pa.string()) for k in range(2))], schema=schema)

    return run


def _ids(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("pieces", path), lambda: PieceEncoder(path))
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            for i, j in groups(texts):
                ids = encoder.encode(texts[i:j])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], pa.ListArray.from_arrays(ids.offsets, ids.values, type=schema.field(1).type)], schema=schema)

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (with the end id) of each row."""
    with small_batches(docs.sparkSession):
        return written(_texts(docs).mapInArrow(_ids(model_path), "doc_id long, ids array<int>"), "piece-ids")


def piece_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    with small_batches(docs.sparkSession):
        return written(_texts(docs).mapInArrow(_digest(model_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"), "piece-digests")
