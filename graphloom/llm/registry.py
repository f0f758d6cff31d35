"""Queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import conversation_trie, fill_middle, line_rules, merge_dropout, pii, quality, sharding, sim_hash, span_dedup, topk_search
from graphloom.llm.binary_ids import read_ids, write_ids
from graphloom.llm.near_dup import near_duplicates
from graphloom.llm.packing import pack_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(_table(spark, sf_dir, "documents"), count_col="n_entities").select("doc_id", "text", "n_entities")


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.drop_repeated_spans(_table(spark, sf_dir, "documents"), removed_col="n_removed").select("doc_id", "text", "n_removed")


def op3_term_at_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk_search.whole_vectors(_table(spark, sf_dir, "embeddings"))
    found = topk_search.top_k(rows, rows.where("id % 50 = 0"), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op5_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("text_md5"), F.octet_length(text).alias("size"))
    return sharding.extendible_shards(rows, ["doc_id", "text_md5"], F.col("size"), sharding.QUERY_BYTES).drop("text_md5")


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encoding_digests(_table(spark, sf_dir, "documents"))


def op7_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(spark, write_ids(_table(spark, sf_dir, "documents")))


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_rules(_table(spark, sf_dir, "documents"))


def op10_semantic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality.classify(documents, quality.fit(documents, _table(spark, sf_dir, "labels")))


def op11_byte_dfa_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restored(F.col("text"), F.col("fim.form"))
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("text", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sim_hash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_family_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations")).drop("node", "parent")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_sentence_spans": op2_sentence_spans,
    "op3_term_at_a_time": op3_term_at_a_time,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_extendible_hashing": op5_extendible_hashing,
    "op6_merge_dropout": op6_merge_dropout,
    "op7_simple8b_ids": op7_simple8b_ids,
    "op8_dart_minhash": op8_dart_minhash,
    "op9_line_frequency": op9_line_frequency,
    "op10_semantic_neighbours": op10_semantic_neighbours,
    "op11_byte_dfa_middles": op11_byte_dfa_middles,
    "op12_pivot_simhash": op12_pivot_simhash,
    "op13_family_trie": op13_family_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op2_sentence_spans": span_dedup.ORACLE_SQL,
    "op3_term_at_a_time": topk_search.ORACLE_SQL,
    "op5_extendible_hashing": sharding.ORACLE_SQL,
    "op9_line_frequency": line_rules.ORACLE_SQL,
    "op11_byte_dfa_middles": fill_middle.ORACLE_SQL,
    "op13_family_trie": conversation_trie.ORACLE_SQL,
}
