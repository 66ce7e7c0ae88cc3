"""The corpus pipeline: documents in, token digests of the cleaned and mixed corpus out.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before it kept. Its result
is written as Parquet and read again for the next stage. All but the last return the columns of ``documents``.

1. toxicity: documents that the classifier rejects go.
2. near_dedup: one document of each group of near copies stays (five-word shingles, similarity 0.8 or more).
3. pii: personal data is replaced by its kind; ``n_chars`` follows the text.
4. mixing: each source comes as often as its budget has it; every document stays at least once.
5. sentencepiece: ids and decoded text of every remaining row, as digests.

Stages keep null and empty texts, null ids and repeated rows as their operators state; columns that are not named here
pass through unchanged, whatever their names, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm import mixing, pii, sentencepiece_bpe, similar, toxicity
from tamarack.llm.common import documents, removed, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the classifier's threshold for their language; the labels train it and are no input of a score."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id, first by SimHash links, then by all similar shingle sets."""
    return similar.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data as its kind in angle brackets; null texts stay null."""
    masked = pii.mask(docs)
    return masked.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its source's budget has it, at least once."""
    return mixing.mix(docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each row's ids, and the digest of the text decoded from them."""
    return sentencepiece_bpe.digests(docs, sentencepiece_bpe.default_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_and_decode),
]

#: SQL can express neither the classifier nor the fingerprints nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        done = written(stage(spark, docs, sf_dir), f"stage-{name}")
        removed(docs)  # tables of earlier stages; the input is none
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
