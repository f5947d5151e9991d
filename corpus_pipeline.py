"""Corpus pipeline: identify languages, drop poor and copied and leaked documents, encode what is left.

Every stage takes the documents its predecessor kept and returns the columns of
``documents``; the last one returns the ids of each text.  All stages treat null and
empty texts, repeated rows, empty tables and extra columns as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import decontaminate, lang_mixture, quality, simhash, unigram
from panelspark.llm.queries import tokenizer_file
from panelspark.session import scratch_path, written

ORACLE_SQL = None    # models, sketches and Viterbi paths have no SQL form; tests/llm compares with brute force


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is identified: some letter, and one language with at least a quarter of the text."""
    model = lang_mixture.train(lang_mixture.training_rows(docs))
    return lang_mixture.keep_identified(docs, model)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a calibrated quality score of at least 0.7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stats = written(quality.measure(docs), "stats")
    return quality.keep_good(docs, quality.fit_held(stats, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of every group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of every text, and whether decoding the ids gives the text back."""
    file = tokenizer_file("piece_bpe_32k.model")
    return unigram.encode_texts(docs, file)


STAGES = [("language", language), ("quality", good_quality), ("near_duplicates", one_of_each),
          ("decontamination", no_benchmark), ("encoding", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
