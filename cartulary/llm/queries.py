"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_tree, divergence, fill_in_middle, line_dedup, ngram_join
from .common import documents


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard

    members, _ = ngram_jaccard(documents(spark, sf_dir).select("doc_id", "text"))
    least = members.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return members.join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    from .packing import pack_documents

    packed = pack_documents(documents(spark, sf_dir).select("doc_id", "text"), path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_digest

    return pii_digest(documents(spark, sf_dir).select("doc_id", "text"))


def op3_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, query="id % 20 = 0")


def op4_three_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    found = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "removed", F.md5("text").alias("text_md5"))


def op5_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import interleave

    docs = documents(spark, sf_dir).select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    )
    sharded = interleave(docs, "source", shards=16)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_digest

    return secret_digest(documents(spark, sf_dir).select("doc_id", "text"))


def op9_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later copies of passages; spans of fewer than 24 words are phrases."""
    from .substring_dedup import repeated_spans

    return repeated_spans(documents(spark, sf_dir).select("doc_id", "text"), min_words=24).drop("text_key")


def op10_kneser_ney_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, train

    docs = documents(spark, sf_dir).withColumn("held_out", F.expr("crc32(cast(doc_id as string)) % 3 = 1"))
    model = train(docs.where("not held_out"))
    found = identify(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op11_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cover_tree import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "n_links", "component_id", "kept")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergence_audit

    return divergence_audit(documents(spark, sf_dir))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fill_in_middle_digest

    return fill_in_middle_digest(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_bootstrapped_pii, op3_learned_partitions, op4_three_line_windows, op5_stratified_interleaving, op6_ngram_jaccard, op7_simhash_decontamination, op8_entropy_secrets, op9_gear_chunks, op10_kneser_ney_language, op11_cover_tree, op12_source_divergence, op13_fill_in_middle)}
ORACLE: dict[str, str] = {"op4_three_line_windows": line_dedup.ORACLE, "op6_ngram_jaccard": ngram_join.ORACLE, "op11_cover_tree": cover_tree.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_fill_in_middle": fill_in_middle.ORACLE}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
