"""The queries opN_<name>: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelflow.llm import clustering, embeddings, langid, licenses, minhash, mixing, packing, quality, secret_scan, suffixes, tokens, toxicity, whitening
from panelflow.llm.common import read_table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_file_digests(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))
    counts = [secret_scan.count_kind(F.col("_base"), kind).alias(f"n_{kind}") for kind in secret_scan.KINDS]
    spans = F.array_sort(F.concat("_base", "_random"))
    return found.select("doc_id", *counts, F.sha2(secret_scan.written(F.col("_base")), 256).alias("base_sha256"), secret_scan.written(spans).alias("spans"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.remove_repeats(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("long").alias("n_kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(read_table(spark, sf_dir, "documents"), only=["doc_id"])
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return scored.select("doc_id", *(F.col("_q")[c].alias(c) for c in columns), "base_failed", "kept", F.round("p_quality", 6).alias("p_quality"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(read_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "n_tokens", "domain", F.round("rate", 6).alias("rate"), "copies")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(read_table(spark, sf_dir, "embeddings"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(read_table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    scored = toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), remainder != 1)
    return scored.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files, op2_minhash, op3_secrets, op4_suffixes, op5_quality,
        op6_embeddings, op7_packing, op8_language, op9_mixing, op10_licenses,
        op11_whitening, op12_centroids, op13_toxicity,
    )
}
