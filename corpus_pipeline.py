"""The corpus pipeline: documents in, digests of their token ids out. Each stage's rows are written as Parquet and read again as the next
one's docs.

What holds for every stage: a null text counts as empty, and other columns may be null. Rows are documents of their own, also with equal
ids or as repeated rows, until near copies go. Ties are broken by id, then by hashes of the row, so reruns agree. An empty table gives an empty one.
Extra columns are carried by all stages but the last, whatever their names; n_chars, where it is there, follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, written
from tessera.llm.op04_pieces import piece_digest
from tessera.llm.op06_mixing import mix
from tessera.llm.op08_simhash_tiles import representatives
from tessera.llm.op09_robust_outliers import accepted
from tessera.llm.op10_patience_lines import without_common_lines
from tessera.llm.queries import tokenizer_path
from tessera.llm.textstats import word_list


def _with_text(rows: DataFrame, row: Column, text: Column, columns: list[str]) -> DataFrame:
    """The columns of row with another text, and n_chars by it. Fields are set in the struct, so that no other column is touched."""
    row = row.withField("text", text)
    if "n_chars" in columns:
        row = row.withField("n_chars", F.length(row["text"]).cast("long"))
    return rows.select(row.alias("row")).select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; so do null, empty and very short texts."""
    return accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines go from later documents, which stay, if empty. Rows with a null doc_id keep their lines, a null text stays null."""
    return _with_text(without_common_lines(docs), F.col("row"), F.col("row.text"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id (null last), of equal rows one."""
    return representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken; where the mix takes only some of its words, its first ones, joined by one space.

    Texts without a word are never taken. Null sources are one source.
    """
    rows = mix(docs, shards=max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    first = F.array_join(F.slice(word_list(F.col("row.text")), F.lit(1), F.col("cut").cast("int")), " ")
    return _with_text(rows, F.col("row"), F.when(F.col("cut").isNull(), F.col("row.text")).otherwise(first), docs.columns)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, encoded and decoded again; a null text has the end id alone."""
    return piece_digest(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", mixing),
    ("piece_encoding", piece_ids),
]

#: SQL expresses neither the robust estimates nor XXH64 fingerprints; tests hold each stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
