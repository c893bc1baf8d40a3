"""Distributed trainers against the loops on one machine."""

import numpy as np
import pytest

from tessera.operators.datasets import stratified_groups, stratified_split, train_linear, train_stumps
from tessera.operators.training import cut_points, fit_hinge, fit_stumps, numbered


def pairs_of(n, width=5, seed=1, distinct=40):
    rng = np.random.default_rng(seed)
    truth = rng.normal(size=width)
    a, b = (rng.integers(0, distinct, (n, width)) / distinct for _ in range(2))
    better = ((a - b) @ truth + rng.normal(scale=0.4, size=n)) > 0
    return np.where(better[:, None], a, b), np.where(better[:, None], b, a)


def frame(spark, p, n):
    return spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(p, n, strict=True)], "p array<double>, n array<double>").repartition(5)


def test_numbers_go_on_over_partitions(spark):
    rows = spark.range(1000).selectExpr("id % 7 AS a", "999 - id AS b")
    got = numbered(rows, "a", "b").collect()
    assert [r.number for r in sorted(got, key=lambda r: (r.a, r.b))] == list(range(1000))


def test_stumps_are_those_of_the_loop(spark):
    p, n = pairs_of(2000, distinct=300)
    want, got = train_stumps(p, n, rounds=12), fit_stumps(frame(spark, p, n), rounds=12)
    assert [x[0] for x in got] == [x[0] for x in want] and np.allclose(np.array(got), np.array(want), atol=1e-9)


def test_cuts_of_few_and_many_values(spark):
    p, n = pairs_of(300, 3, distinct=500)
    p[:, 1] = n[:, 1] = 7.0
    p[:, 2], n[:, 2] = 0.0, np.arange(300) % 2
    cuts = cut_points(frame(spark, p, n), 20)
    assert [len(x) for x in cuts] == [20, 0, 1] and cuts[2].tolist() == [0.5]
    assert fit_stumps(frame(spark, p, n), rounds=1)[0][:2] == (2, 0.5)


def test_hinge_is_proved_to_be_near_the_least_objective(spark):
    p, n = pairs_of(3000)
    d, l2 = p - n, 0.01
    objective = lambda w: np.maximum(0, 1 - d @ w).mean() + l2 / 2 * w @ w
    w, value, least = fit_hinge(frame(spark, p, n), l2)
    assert value - least <= 1e-3 and np.isclose(objective(w), value)
    assert value <= objective(np.array(train_linear(d, l2=l2))) + 1e-3
    rng = np.random.default_rng(2)
    assert all(objective(w + rng.normal(scale=s, size=len(w))) >= least for s in (0.01, 0.1, 1.0) for _ in range(20))


@pytest.mark.parametrize("fit", [fit_stumps, lambda x: fit_hinge(x)[0].tolist()])
def test_no_pairs(spark, fit):
    assert fit(spark.createDataFrame([], "p array<double>, n array<double>")) == []


def test_stratified_split_by_repository_is_the_one_in_order(spark):
    rng = np.random.default_rng(3)
    rows = [(f"r{i:02}", f"g{g}") for i in range(12) for g in range(rng.integers(1, 9)) for _ in range(rng.integers(1, 6))]
    counts = {}
    for k in rows:
        counts[k] = counts.get(k, 0) + 1
    want = stratified_groups([(*k, n) for k, n in counts.items()])
    got = stratified_split(spark.createDataFrame(rows, "repository string, grp string").repartition(4)).collect()
    assert {(r.repository, r.grp): r.split for r in got} == want and len(got) == len(want)


def test_rounds_read_packed_matrices(spark, monkeypatch):
    """Each round of a fit reads its pairs as bytes of matrices; arrays are read only to make these."""
    from tessera.operators import training

    read = []
    monkeypatch.setattr(training, "_summed", lambda rows, *a, f=training._summed: read.append(rows.dtypes) or f(rows, *a))
    p, n = pairs_of(100)
    fit_stumps(frame(spark, p, n), rounds=2)
    fit_hinge(frame(spark, p, n))
    assert read and all(x == [("x", "binary")] for x in read)
