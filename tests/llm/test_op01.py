import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.op01_chunk_recipes import cut_points, exact_groups

from .conftest import SCHEMA, frame


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = []
    for i, t, *_ in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 3])
def test_against_brute_force(spark, awkward, bits):
    got = exact_groups(frame(spark, awkward), least=64, average_bits=7, most=512, id_bits=bits).collect()
    assert sorted(map(tuple, got), key=str) == brute(awkward)


def test_empty_table_and_clashing_columns(spark):
    assert exact_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = frame(spark, [(1, "x", None, None), (2, "x", None, None)]).withColumns({c: F.lit(0) for c in ("h", "chunk", "keep_id", "recipe", "kept")})
    assert sorted(map(tuple, exact_groups(docs).select("doc_id", "keep_id", "kept").collect())) == [(1, 2, False), (2, 2, True)]


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 200_000, dtype=np.uint8)
    shifted = np.concatenate([rng.integers(97, 123, 333, dtype=np.uint8), body])
    a, b = (cut_points(x, np.array([0, len(x)]), 1024, 12, 16384)[0] for x in (body, shifted))
    assert len({x + 333 for x in a} & set(b)) >= 0.9 * len(a)
