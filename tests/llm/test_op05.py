import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.op05_rule_ensemble import fit, quality_scores, scores, statistics, train

from .conftest import SCHEMA, frame, prose


def corpus(spark, n=400):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words, bad = prose(rng, rng.randrange(30, 200), 5000).split(), rng.random() < 0.2
        if bad:
            words = [w + rng.choice(["###", "$$$"]) for w in words] if i % 2 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "en", "s"))
        labels.append((i, None if i % 50 == 7 else int(not bad), 0))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_held_out_accuracy_and_columns(spark):
    docs, labels, _, known = corpus(spark)
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    right = total = 0
    for i, y, _ in known:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out and y is not None:
            total, right = total + 1, right + (r.predicted == y)
    assert total > 40 and right >= 0.95 * total


def test_compiled_column_is_the_model(spark):
    docs, labels, *_ = corpus(spark)
    model = train(docs, labels)
    assert 0 < len(model.rules) < 90
    stats, names = statistics(docs, [F.col("doc_id")])
    rows = sorted(stats.collect(), key=lambda r: r.doc_id)
    want = model.score(np.array([[r[c] for c in names] for r in rows]))
    assert np.allclose([r.score for r in sorted(scores(docs, model).collect(), key=lambda r: r.doc_id)], want)


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    docs, labels, *_ = corpus(spark)
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = train(docs, labels), train(docs, turned)
    assert a.rules == b.rules and a.weights == b.weights


def test_awkward_rows(spark, awkward):
    docs, labels, *_ = corpus(spark, 120)
    got = scores(frame(spark, awkward), train(docs, labels)).collect()
    assert len(got) == len(awkward) and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_scores(frame(spark, awkward), none).collect()} == {0.5}
    assert quality_scores(spark.createDataFrame([], SCHEMA), labels).collect() == []
    clashing = docs.withColumns({c: F.lit(1) for c in ("s_size", "words", "y", "score", "n_upper")})
    assert quality_scores(clashing, labels).count() == 120


def test_lasso_keeps_few_rules():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 6))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.8)).astype(float)
    model = fit(x, y, list("abcdef"))
    assert (np.round(model.score(x)) == y).mean() > 0.97 and len(model.rules) < 90
    strong = {k for r, w in zip(model.rules, model.weights, strict=True) if abs(w) > 0.5 for k, *_ in r}
    assert {0, 3} <= strong


def test_repeated_ids_fit_the_same_model(spark):
    """Of several texts with one id the least is learnt from, however the rows are dealt."""
    _, labels, rows, _ = corpus(spark, 150)
    twice = rows + [(i, "zzz " * (40 + i), "en", "s") for i, *_ in rows[::3]] + rows[::5]
    first = train(frame(spark, twice).repartition(3), labels)
    for n in (1, 8):
        again = train(frame(spark, twice[::-1]).repartition(n), labels)
        assert again.rules == first.rules and again.weights == first.weights and again.intercept == first.intercept
