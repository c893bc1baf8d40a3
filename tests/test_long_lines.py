"""The index of grams takes a line in one pass: a long line with letters beyond ASCII was quadratic."""

import time

from tessera.operators.substring import LineIndex
from tessera.storage import new_folder


def test_a_long_line_is_indexed_in_one_pass(spark):
    rows = [(1, "é" + "abcdé fgh中🙂 " * 30_000 + "needle"), (2, "x\nneedle\r\nnee\ndle"), (3, None), (4, "")]
    units = spark.createDataFrame(rows, "unit_id long, content string")
    units.count()
    began = time.time()
    index = LineIndex.build(units, new_folder(spark, "test-lines"))
    took = time.time() - began
    needles = spark.createDataFrame([(0, "needle"), (1, "🙂 a"), (2, "e\n"), (3, "e\r")], "needle_id long, needle string")
    assert sorted(map(tuple, index.search(needles).collect())) == [(0, 1, 1), (0, 2, 2), (1, 1, 1), (3, 2, 2)]
    assert took < 25
