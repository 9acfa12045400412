"""The registered queries of this subpackage: thin contracts over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import conversations, encoding, jaccard, language, licenses, linededup, negatives, packing, passages, quality, sharding, topk, urls
from lexmill.llm.common import table


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_frequency_rules(table(spark, sf_dir, "documents")).drop("row_id", "host", "text_hash", "removed_lines")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op3_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.feistel_sharding(table(spark, sf_dir, "documents"))


def op5_suffix_array_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.without_repeated_runs(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "removed_lines")


def op6_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_decode(table(spark, sf_dir, "documents"))


def op7_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.mtree_topk(table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"))


def op10_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.rank_order_language(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired_damage(table(spark, sf_dir, "conversations"))


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.without_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.relabelled(table(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_frequency, op2_best_fit_packing, op3_prefix_tree_join, op4_feistel_shards, op5_suffix_array_lines, op6_tree_bpe, op7_mtree_topk, op8_license_scan, op9_url_filter, op10_rank_order_language, op11_conversation_repair, op12_repeated_passages, op13_hard_negatives, pipeline)}

ORACLES: dict[str, str] = {"op1_line_frequency": quality.ORACLE, "op7_mtree_topk": topk.ORACLE, "op11_conversation_repair": conversations.ORACLE, "op13_hard_negatives": negatives.ORACLE}
