"""Pairs, and features, are made from few columns in one pass."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.datasets import pairs_within
from tessera.plans.datasets import described, training_pairs
from tessera.plans.ranking import feature_vector, features, least_vector, with_unit_features

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_up_to_the_cap_without_a_join(spark):
    rng = random.Random(4)
    rows = list({(e, rng.randrange(40), rng.choice([0, 1, None])) for e in range(12) for _ in range(6 * e)})
    got = pairs_within(spark.createDataFrame(rows, "episode_id long, unit_id long, label int").repartition(3), 30)
    want = []
    for e in range(12):
        side = lambda v: sorted(u for k, u, y in rows if (k, y) == (e, v))  # noqa: B023, E731
        want += [(e, p, n) for p in side(1) for n in side(0)][:30] if rows else []
    assert sorted(map(tuple, got.collect())) == sorted(want) and "Join" not in plan(got)


def test_values_go_with_their_units(spark):
    rows = spark.createDataFrame([(1, u, u % 2, f"v{u}") for u in range(6)], "episode_id long, unit_id long, label int, v string")
    got = pairs_within(rows, value="v").collect()
    assert len(got) == 9 and all((r.p, r.n) == (f"v{r.positive}", f"v{r.negative}") for r in got)


def test_distinct_lines_are_shuffled_without_the_unit_s_features(spark):
    _, exchange = plan(features(spark, FOLDER).select("task_id", "heuristic_score", "kind")).split("Exchange", 1)
    assert "is_test" not in exchange and "LOCKFILE" not in exchange


@pytest.mark.parametrize("split", ["train", "validation"])
def test_least_vectors_are_those_of_all_features(spark, split):
    from tessera.plans.datasets import assignments

    every = features(spark, FOLDER).select(F.col("task_id").alias("episode_id"), "unit_id", feature_vector().alias("v")).groupBy("episode_id", "unit_id").agg(F.min("v").alias("v"))
    want = every.join(assignments(spark, FOLDER).filter(F.col("split") == split), "episode_id").select("episode_id", "unit_id", "v").collect()
    own = described(spark, FOLDER, least_vector(), split).select("episode_id", "unit_id", "v.*")
    got = with_unit_features(own).select("episode_id", "unit_id", feature_vector().alias("v")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_training_pairs_hold_vectors(spark):
    r = training_pairs(spark, FOLDER).first()
    assert len(r.p) == len(r.n) == 33
