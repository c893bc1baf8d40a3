"""Overlap ratios of all pairs of task and unit that share a token, not of chosen candidates alone."""

from tessera import catalog
from tessera.operators.retrieval import shared_overlap_ratios


def test_every_pair_that_shares_a_token(spark):
    tasks = spark.createDataFrame([(1, "alpha beta beta on"), (2, "gamma"), (3, "")], "task_id int, prompt string")
    units = spark.createDataFrame([(i, "Beta alpha" if i % 2 else "beta") for i in range(300)] + [(900, "delta"), (901, None)], "unit_id int, content string")
    got = {(r.task_id, r.unit_id): round(r.overlap_ratio, 6) for r in shared_overlap_ratios(tasks, units).collect()}
    assert got == {(1, i): 1.0 if i % 2 else 0.666667 for i in range(300)}


def test_the_query_takes_more_than_lexical_candidates(spark):
    rows = catalog.QUERIES["r05_overlap_ratio"](spark, "/root/testdata/sf0.001")
    assert rows.groupBy("task_id").count().agg({"count": "max"}).first()[0] > 100
