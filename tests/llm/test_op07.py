import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm.op07_phrase_automata import without_repeats

from .conftest import SCHEMA, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first, words = {}, [WORD.findall(r[1] or "") for r in rows]
    for r, w in zip(rows, words, strict=True):
        for i in range(len(w) - window + 1):
            if r[0] is not None:
                key = tuple(w[i : i + window])
                first[key] = min(r[0], first.get(key, r[0]))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if r[0] is not None and first[tuple(w[i : i + window])] < r[0]:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def planted(rng, n, window):
    rows, pool = [], [prose(rng, rng.randrange(window - 2, window * 4)) for _ in range(12)]
    for i in range(n):
        parts = [prose(rng, rng.randrange(0, 120)) for _ in range(3)]
        for p in rng.sample(pool, rng.randrange(0, 3)):
            words = p.split()
            a = rng.randrange(0, max(1, len(words) - window + 2))
            parts.insert(rng.randrange(len(parts) + 1), " ".join(words[a:]))
        if rows and rng.random() < 0.2:
            words = (rng.choice(rows)[1] or "").split()
            if words:
                words[rng.randrange(len(words))] = "changed"
            parts = [" ".join(words)]
        rows.append((i * 3 % 101 + 1000, "  ".join(parts), None, None))
    return rows


@pytest.mark.parametrize(("window", "anchor", "piece", "letters"), [(50, 10, 500, 600_000), (12, 4, 5, 300), (5, 2, 500, 50)])
def test_against_brute_force(spark, awkward, window, anchor, piece, letters):
    rows = awkward + planted(random.Random(window), 90, window)
    got = without_repeats(frame(spark, rows), window, anchor, piece, letters).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, window)


def test_low_entropy_texts(spark):
    rows = [(i, " ".join(["a b"[:: 1 + i % 2]] * (30 + i)), None, None) for i in range(12)] + [(50, "a " * 400, None, None), (51, "a " * 399, None, None)]
    assert sorted(map(tuple, without_repeats(frame(spark, rows), 20, 4).collect()), key=str) == brute(rows, 20)


def test_empty_table_clashing_columns_and_text(spark):
    assert without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = frame(spark, [(1, "a b c d e f", None, None), (2, "x a b c d e y", None, None)]).withColumns({c: F.lit(1) for c in ("patterns", "picks", "wanted", "anchor")})
    got = without_repeats(docs, 4, 2, full=True).select("doc_id", "kept_text").collect()
    assert sorted(map(tuple, got)) == [(1, "a b c d e f"), (2, "x y")]
