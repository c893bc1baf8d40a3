import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm.op06_mixing import mix_report
from tessera.llm.op09_robust_outliers import quality_verdicts

from . import test_op08, test_op10
from .conftest import frame, prose

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(12)
    rows = []
    for i in range(160):
        lines = [prose(rng, 14, 5000).replace("\n", "") for _ in range(10)]
        if rows and i % 8 == 0:
            lines = rng.choice(rows)[1].split("\n")
            if i % 16 == 0:
                lines = [x + " tail" for x in lines]
        if i % 20 == 3:
            lines = [" ".join(w + "###" for w in x.split()) for x in lines]
        rows.append((500 - i, "\n".join(lines), "en", f"s{i % 3}"))
    return [*rows, (900, "short", "en", None), (901, None, None, None)]


def test_each_stage_against_its_rule(spark):
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mixing", "piece_encoding"]
    docs = frame(spark, corpus())
    verdicts = {r.doc_id: r.kept for r in quality_verdicts(docs).collect()}
    one = stage["quality_rules"](spark, docs, "")
    assert one.columns == COLUMNS and {r.doc_id for r in one.collect()} == {i for i, kept in verdicts.items() if kept}
    assert not verdicts[900] and not any(verdicts[500 - i] for i in range(160) if i % 20 == 3 and i % 8)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in one.collect()]
    two = stage["line_dedup"](spark, frame(spark, rows), "")
    kept = {r.doc_id: r.text for r in two.collect()}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()} == {i: h for i, _, _, h in test_op10.brute(rows, len(rows), 5)}
    assert two.columns == COLUMNS and len(kept) == len(rows) and all(r.n_chars == len(r.text) for r in two.collect())
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in two.collect()]
    three = stage["simhash_near_dedup"](spark, frame(spark, rows), "")
    assert three.columns == COLUMNS and sorted(r.doc_id for r in three.collect()) == sorted({c for _, _, c in test_op08.brute(rows)})
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in three.collect()]
    four = stage["source_mixing"](spark, frame(spark, rows), "")
    words = Counter()
    for r in four.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert four.columns == COLUMNS and dict(words) == {r.doc_id: r.taken for r in mix_report(frame(spark, rows)).collect() if r.taken}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    five = stage["piece_encoding"](spark, four, "")
    assert Counter((r.doc_id, r.n_tokens) for r in five.collect()) == Counter((r.doc_id, len(model.encode(r.text)) + 1) for r in four.collect())


def test_run(spark, tmp_path):
    frame(spark, corpus()).write.parquet(f"{tmp_path}/documents.parquet")
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) for _ in range(2))
    assert a == b and len(a) > 100
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


AWKWARD = ["row", "_row", "_text", "k1", "k2", "k3", "_k1", "key", "_key", "unit", "shard", "place", "copy", "cut", "home", "homes", "words", "size", "kept", "gone", "_gone", "_n_removed", "n_removed", "lines", "label", "fp", "first", "group", "kind", "distance", "block", "draw"]


def test_stages_carry_nulls_ties_repeated_rows_and_clashing_columns(spark):
    """Every stage on rows with nulls, equal ids with different texts, repeated rows and columns with its internal names."""
    texts = ["\n".join(f"word{i}a{k} stands by word{i}b{k} in line" for k in range(12)) for i in range(12)]
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s1"), (3, texts[0] + "\nand more", "en", "s1"), (5, texts[7], None, None), (None, texts[8], None, None), (None, None, None, None), (20, "", "en", "s1")]
    docs = frame(spark, rows).withColumns({c: F.lit(f"own {c}") for c in AWKWARD})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        held = got.collect()
        assert held and all(r[c] == f"own {c}" for r in held for c in AWKWARD), name
        assert all(r.n_chars == len(r.text) for r in held if r.text is not None), name
        if name == "line_dedup":
            assert len(held) == len(rows) and sum(r.text is None for r in held) == 1
        if name == "simhash_near_dedup":
            assert sorted(((r.doc_id, r.text) for r in held), key=str) == sorted([(5 if i == 7 else i, t) for i, t in enumerate(texts)] + [(20, "")], key=str)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(rows)
    plain = docs.select("doc_id", "text", "lang", "source")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, plain, "").columns == plain.columns, name
