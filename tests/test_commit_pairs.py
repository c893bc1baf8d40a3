"""Pairs of files are counted before they leave a task."""

import pyarrow as pa

from tessera.operators.history import _paired


def test_pairs_of_a_batch_are_counted_at_once():
    held = [["a", "b", "c"], ["a", "b", "c"], ["b", "é"], ["x"], [], ["b", "é"]]
    got = [r for b in _paired(iter([pa.RecordBatch.from_pydict({"held": pa.array(held, pa.list_(pa.string()))})])) for r in b.to_pylist()]
    assert sorted((r["file"], r["other"], r["shared"]) for r in got) == [("a", "b", 2), ("a", "c", 2), ("b", "c", 2), ("b", "é", 2)]
