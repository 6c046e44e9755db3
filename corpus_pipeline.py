"""A corpus in four stages. Each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import decontaminate, line_crf, queries, sentencepiece_codec, shared, shingle_join, simhash


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_crf.kept(docs, queries.quality_model(spark, docs, sf_dir), queries.QUALITY)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By five-word shingles at a similarity of 0.8 or more, with SimHash fingerprints as the filter; op2's radius of 2 bits is the contract of that query alone."""
    return simhash.firsts(docs, shingle_join.rows_of(docs))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, shared.table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip_digests(docs, queries.tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", good),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", clean),
    ("SentencePiece encoding and decoding", encoded),
]

#: Fingerprints, a trained classifier and a tokenizer's merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.written(docs, "stage")
    return docs
