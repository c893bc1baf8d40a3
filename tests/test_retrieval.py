"""Evidence in the channels, and the lexical index against scoring every pair."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.flow import channels
from tessera.operators.lexical import LexicalIndex, lexical_scores, query_terms
from tessera.operators.retrieval import exact_matches, top_per
from tessera.storage import new_folder

UNITS = "unit_id long, path string, title string, kind string"
TEXTS = "task_id long, kind string, path string, function string, title string, body string, trace string, message string"


def evidence_rows(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in TEXTS.split(", ")) for r in rows], TEXTS)


@pytest.fixture(scope="module")
def repository(spark):
    return spark.createDataFrame([(1, "src/webhook.ts", "webhook.ts", "SOURCE_FILE"), (2, "src/deduplicator.ts", "deduplicator.ts", "SOURCE_FILE"), (3, "src/redis_lock.ts", "redis_lock.ts", "SOURCE_FILE"), (4, "src/payment.ts", "payment.ts", "SOURCE_FILE")], UNITS)


def found(spark, repository, evidence):
    tasks = spark.createDataFrame([(7, "please fix the retries"), (8, "nothing here")], "task_id long, prompt string")
    edges = spark.createDataFrame([], "src long, dst long, kind string")
    commits = spark.createDataFrame([], "sha long, ts timestamp, file string")
    out = {}
    for c in channels(tasks, evidence, repository, edges, commits, "2024-01-01 00:00:00"):
        for r in c.collect():
            out.setdefault(r.source, set()).add((r.task_id, r.unit_id))
    return out


def test_only_a_message_names_the_file(spark, repository):
    assert found(spark, repository, evidence_rows(spark)) == {}
    said = {"task_id": 7, "kind": "COMPILER_ERROR", "message": "redis_lock.ts: lock was lost"}
    assert found(spark, repository, evidence_rows(spark, said)) == {"exact": {(7, 3)}, "lexical": {(7, 3)}}


def test_titles_bodies_and_traces_are_read_by_the_exact_channel_alone(spark, repository):
    rows = [{"task_id": 7, "title": "webhook.ts hangs", "body": "see src/payment.ts"}, {"task_id": 8, "trace": "at reserve (deduplicator.ts:5)"}, {"task_id": 9, "message": "webhook.ts"}]
    out = found(spark, repository, evidence_rows(spark, *rows))
    assert out == {"exact": {(7, 1), (7, 4), (8, 2)}}


def test_title_hides_trace_and_message_from_the_exact_channel(spark, repository):
    units = repository.withColumns({"qualified_name": F.lit(None).cast("string"), "name": F.lit(None).cast("string")})
    tasks = spark.createDataFrame([(7, "")], "task_id long, prompt string")
    said = evidence_rows(spark, {"task_id": 7, "title": "broken", "trace": "webhook.ts", "message": "payment.ts"}, {"task_id": 7, "trace": "redis_lock.ts", "message": "deduplicator.ts"})
    assert {r.unit_id for r in exact_matches(tasks, units, said).collect()} == {3}
    assert {r.unit_id for r in top_per(lexical_scores(tasks, units, said), "task_id", "lexical_score", "unit_id", 10).collect()} == {2, 4}


def corpus(spark, n, vocabulary=300):
    rng = random.Random(5)
    rows = [(i, f"src/{'common' if i % 2 else 'other'}/{' '.join(f'word{int(rng.paretovariate(0.7)) % vocabulary}' for _ in range(rng.randrange(1, 9)))}.ts", f"unit_{i}", "SOURCE_FILE") for i in range(n)]
    prompts = [(t, f"the common unit_{t * 7} and word{rng.randrange(vocabulary)} or word{rng.randrange(20)}") for t in range(30)] + [(97, "common"), (98, ""), (99, "nosuchword")]
    return spark.createDataFrame(rows, UNITS), spark.createDataFrame(prompts, "task_id long, prompt string")


@pytest.mark.parametrize(("k", "block"), [(10, 4), (10, 128), (100, 16), (1, 1)])
def test_index_gives_what_scoring_all_pairs_gives(spark, k, block):
    units, tasks = corpus(spark, 3000)
    said = evidence_rows(spark, *({"task_id": t, "message": f"unit_{t} is not word3"} for t in range(0, 30, 3)))
    want = top_per(lexical_scores(tasks, units, said), "task_id", "lexical_score", "unit_id", k)
    got = LexicalIndex.build(units, new_folder(spark, "test-index"), block).top(query_terms(tasks, said), k)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_a_term_in_half_of_the_units_is_not_scored_for_all_of_them(spark):
    units, tasks = corpus(spark, 6000)
    terms = query_terms(tasks)
    index = LexicalIndex.build(units, new_folder(spark, "test-index"), 16)
    scored, pairs = index.candidates(terms, 10).count(), lexical_scores(tasks, units).count()
    assert pairs > 31 * 3000 and scored < pairs / 10


def test_index_of_no_units_and_no_tasks(spark):
    units, tasks = corpus(spark, 5)
    index = LexicalIndex.build(units.limit(0), new_folder(spark, "test-index"))
    assert index.top(query_terms(tasks), 5).collect() == []
    assert LexicalIndex.build(units, new_folder(spark, "test-index")).top(query_terms(tasks.limit(0)), 5).collect() == []
