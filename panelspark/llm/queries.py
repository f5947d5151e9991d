"""The thirteen operators and the pipeline as registered queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import (arrow_pack, backoff_lm, decontaminate, filter_audit, iblt, importance, lang_mixture, mixing,
                            quality, sharding, simhash, token_count, unigram)
from panelspark.session import scratch_path

QUERIES: dict = {}
# checksums, models, sketches, subset sums and Viterbi paths have no SQL form; tests/llm holds brute-force versions
ORACLE: dict = {"op11_filter_audit": filter_audit.SQL}


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file on this machine and its executors."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score_texts(table(spark, sf_dir, "documents"))


@register
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "packed")
    arrow_pack.write_packed(table(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json"))
    return arrow_pack.read_packed(spark, folder)


@register
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode_and_check(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@register
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprint_pairs(table(spark, sf_dir, "documents"))


@register
def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@register
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lang_mixture.identify(docs, lang_mixture.train(lang_mixture.training_rows(docs)))
    return found.select("doc_id", (lang_mixture.crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


@register
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)
