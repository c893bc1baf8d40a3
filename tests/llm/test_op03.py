import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import new_folder
from tessera.llm.op03_arrow_tokens import open_shard, read_documents, token_digest, write_shards

from .conftest import SCHEMA, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, awkward):
    rows = [r for r in awkward if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values()) + [(None, "only one", None, None)]
    got = token_digest(frame(spark, rows), PATH, length=64).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows)


def test_repeated_ids_and_empty_table(spark, awkward):
    got = token_digest(frame(spark, awkward), PATH, length=64).collect()
    assert len(got) == len(awkward) and sum(r.n_tokens for r in got) == brute(awkward)[-1][1] + brute(awkward)[-1][2]
    assert token_digest(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_sequences_have_equal_length_and_masks(spark):
    folder = new_folder(spark, "test-shards")
    manifest = write_shards(frame(spark, [(i, "some words here " * (i + 1), None, None) for i in range(50)]), PATH, folder, length=32, shards=3)
    for x in manifest:
        table = open_shard(folder, x["shard"], "sequences").read_all()
        mask = np.array([m for row in table["mask"].to_pylist() for m in row])
        assert table.num_rows == x["sequences"] and mask.sum() == x["tokens"] and mask[: x["tokens"]].all()
    assert read_documents(spark, folder, manifest).count() == 50


def test_columns_of_any_name(spark):
    rows = [(i, f"some words {i}", "en", "s") for i in range(20)]
    docs = frame(spark, rows).withColumns({c: F.lit(f"own {c}") for c in ("ids", "mask", "offset", "n_tokens", "shard", "base", "start", "sequences")})
    assert sorted(map(tuple, token_digest(docs, PATH, length=32).collect()), key=lambda r: r[1]) == brute(rows)
