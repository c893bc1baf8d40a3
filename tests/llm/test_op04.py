import hashlib

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm.op04_pieces import encode_pieces, piece_digest

from .conftest import SCHEMA, frame

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_against_the_library(spark, awkward):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = []
    for i, t, *_ in awkward:
        ids = [*model.encode(t or ""), model.eos_id()]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, piece_digest(frame(spark, awkward), PATH).collect()), key=str) == sorted(want, key=str)
    ids = {r.doc_id: r.ids for r in encode_pieces(frame(spark, awkward), PATH).filter("doc_id is not null").collect()}
    assert all(ids[i] == [*model.encode(t or ""), 2] for i, t, *_ in awkward if i is not None)


def test_empty_table(spark):
    assert piece_digest(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_columns_of_any_name(spark):
    docs = frame(spark, [(i, f"some words {i}", "en", "s") for i in range(20)])
    more = docs.withColumns({c: F.lit(f"own {c}") for c in ("ids", "n_tokens", "ids_sha256", "decoded_sha256")})
    assert sorted(map(tuple, piece_digest(more, PATH).collect())) == sorted(map(tuple, piece_digest(docs, PATH).collect()))
