"""Containment cuts texts into words once, in one pass each, and only where needles ask for it a second time."""

import pyarrow as pa

from tessera.operators import retrieval
from tessera.operators.retrieval import _distinct_words, containing


def test_words_of_a_batch():
    batch = pa.RecordBatch.from_pydict({"h": pa.array([1, 2, 3]), "text": ["a b_1, a\nñb", "", "..x"]})
    got = [(r["h"], r["key"]) for b in _distinct_words(iter([batch])) for r in b.to_pylist()]
    assert sorted(got) == [(1, "a"), (1, "b"), (1, "b_1"), (3, "x")]


def test_pairs_with_and_without_inner_words(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(retrieval, "settled", lambda df, tag, f=retrieval.settled: cuts.append(tag) or f(df, tag))
    hay = spark.createDataFrame([(1, "one two three"), (2, "one two three"), (3, "xtwo thr"), (4, None), (5, "?? !!")], "u long, content string")
    needles = spark.createDataFrame([(1, "e two t"), (2, "wo"), (3, "?? "), (4, ""), (5, "o thr")], "t long, passage string")
    got = {(r.u, r.t) for r in containing(hay, needles, "content", "passage").collect()}
    assert got == {(1, 1), (2, 1), (1, 2), (2, 2), (3, 2), (5, 3), (1, 5), (2, 5), (3, 5)} and cuts == ["known-words"]
