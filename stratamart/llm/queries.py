"""One query per operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamart.llm import licences, trie_sql
from stratamart.session import ship_package

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from stratamart.llm.packing import pack, pieces

    return pack(pieces(table(spark, folder, "documents"), TOKENIZER))


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from stratamart.llm.minhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from stratamart.llm.mixing import mixed_documents

    return mixed_documents(table(spark, folder, "documents"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from stratamart.llm.quality_rules import quality_rules

    found = quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from stratamart.llm.licences import licence_scan

    found = licence_scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "sentence_ids", "licences", "n_sentences", "n_unknown")


def op4_ngram_lm(spark: SparkSession, folder: str) -> DataFrame:
    from stratamart.llm.ngram_lm import language_model_scores

    return language_model_scores(table(spark, folder, "documents"))


def op6_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    from stratamart.llm.line_crf import line_quality

    return line_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from stratamart.llm.suffix_dedup import repeated_bytes

    return repeated_bytes(table(spark, folder, "documents"))


def op8_metric_join(spark: SparkSession, folder: str) -> DataFrame:
    from stratamart.llm.metric_join import near_vectors

    return near_vectors(table(spark, folder, "embeddings"))


def op10_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    from stratamart.llm.html_extract import main_text

    return main_text(table(spark, folder, "pages"))


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    from stratamart.llm.byte_bpe import decode, encode

    found = decode(encode(table(spark, folder, "documents"), RANKS), RANKS)
    return found.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from stratamart.llm.whitening import fit_whitening, whiten

    vectors = table(spark, folder, "embeddings")
    return whiten(vectors, fit_whitening(vectors))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from stratamart.llm.prefix_trie import prefix_trie, rebuild

    return prefix_trie(rebuild(table(spark, folder, "conversations")))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_best_fit_packing, op3_minhash_near_dedup, op4_ngram_lm, op5_source_mixing,
    op6_line_crf, op7_suffix_dedup, op8_metric_join, op9_quality_rules, op10_html_extract,
    op11_byte_bpe, op12_whitening, op13_prefix_trie,
)}
ORACLES: dict[str, str] = {"op1_license_scan": licences.oracle(), "op13_prefix_trie": trie_sql.SQL}
