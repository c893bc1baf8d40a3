"""Overlaps of prompts: all pairs, by keys that no frequent word makes large."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators.datasets import _overlap_keys, prompt_overlaps, prompt_words


def test_overlaps_of_near_copies_of_all_sizes(spark):
    rng = np.random.default_rng(5)
    texts = []
    for i in range(80):
        words = [f"w{k}" for k in rng.choice(300, int(rng.integers(1, 60)), replace=False)]
        texts += [words, [*words, "again"], [*words, "again", "please"], words[1:], words[: max(1, int(len(words) * 0.86))]]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)] + [(9000, ""), (9001, None)], "id int, prompt string")
    sets = [set(w) for w in texts]
    for threshold in (0.85, 0.5):
        want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if j < i and len(x & y) / len(x | y) > threshold}
        got = [(r.new_id, r.prior_id) for r in prompt_overlaps(rows, rows, threshold).filter("new_id > prior_id").collect()]
        assert set(got) == want and len(got) == len(want)


def test_a_word_in_every_prompt_makes_no_pairs(spark):
    """Prompts of ten words, of which five stand in all: single words as keys would make a pair of each two."""
    rng = np.random.default_rng(6)
    texts = [(i, " ".join([f"c{k}" for k in range(5)] + [f"w{k}" for k in rng.choice(12, 5, replace=False)])) for i in range(600)]
    rows = spark.createDataFrame(texts, "id int, prompt string").select("id", prompt_words(F.col("prompt")).alias("words"))
    keys = _overlap_keys(rows, 0.85)
    met = keys.join(keys.withColumnsRenamed({"id": "other", "size": "n", "bits": "q"}), "key").select("id", "other").distinct().count()
    assert met < 600 * 600 / 2
