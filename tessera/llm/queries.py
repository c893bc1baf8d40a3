"""The queries opN_<name> and pipeline, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import oracles
from tessera.llm.common import documents
from tessera.llm.op01_chunk_recipes import exact_groups
from tessera.llm.op02_disclosure import private_spans
from tessera.llm.op03_arrow_tokens import token_digest
from tessera.llm.op04_pieces import piece_digest
from tessera.llm.op05_rule_ensemble import quality_scores
from tessera.llm.op06_mixing import mix_report
from tessera.llm.op07_phrase_automata import without_repeats
from tessera.llm.op08_simhash_tiles import near_groups
from tessera.llm.op09_robust_outliers import quality_verdicts
from tessera.llm.op10_patience_lines import line_digest
from tessera.llm.op11_funnels import funnel_report
from tessera.llm.op12_jump_shards import shard_report
from tessera.llm.op13_prefix_trie import trie


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op2_disclosure_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans(documents(spark, sf_dir))


def op3_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op5_rule_ensemble_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(documents(spark, sf_dir))


def op7_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))


def op8_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))


def op9_robust_outlier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir))


def op10_patience_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digest(documents(spark, sf_dir))


def op11_ordered_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel_report(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


def op12_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chunk_recipe_dedup": op1_chunk_recipe_dedup,
    "op2_disclosure_sanitisation": op2_disclosure_sanitisation,
    "op3_arrow_token_files": op3_arrow_token_files,
    "op4_piece_encoding": op4_piece_encoding,
    "op5_rule_ensemble_quality": op5_rule_ensemble_quality,
    "op6_hypergeometric_mix": op6_hypergeometric_mix,
    "op7_phrase_automata": op7_phrase_automata,
    "op8_simhash_tiles": op8_simhash_tiles,
    "op9_robust_outlier_rules": op9_robust_outlier_rules,
    "op10_patience_line_dedup": op10_patience_line_dedup,
    "op11_ordered_funnels": op11_ordered_funnels,
    "op12_jump_shards": op12_jump_shards,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chunk_recipe_dedup": oracles.OP1,
    "op7_phrase_automata": oracles.OP7,
    "op11_ordered_funnels": oracles.OP11,
    "op13_prefix_trie": oracles.OP13,
}
