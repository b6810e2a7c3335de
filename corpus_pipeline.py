"""A pipeline over ``documents``, from raw texts to token ids.

Every stage takes a table with the columns of documents and keeps whole rows; the last one returns ids. Extra columns go
through all stages but the last, whatever their names. Texts are joined back to decisions by doc_id and a digest of the text, as a
shuffle on both sides; ids may be null or repeat. Of rows that repeat both id and text one stays, that with the smallest hash of all
its columns; rows that share an id, or have none, but differ in their texts are documents of their own, of which only copies and near
copies go. An empty table stays empty. Each operator says what it makes of odd texts.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm import byte_bpe, exact_dedup, mixing, simhash, toxicity
from docledger.llm.common import one_of_each, table, whole_text, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _doc_id() -> Column:
    return F.col("doc_id").cast("bigint").alias("doc_id")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go; the model is learned from the labels of the training side."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id stays."""
    kept = exact_dedup.deduplicate(docs).where("kept").select(F.struct("doc_id", "digest").alias("key"))
    return one_of_each(docs, [_doc_id(), exact_dedup.digest_of(whole_text()).alias("digest")], kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest doc_id stays (of several with that id, the one with the smallest hash of its text)."""
    found = simhash.near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("key"))
    return one_of_each(docs, [_doc_id(), simhash.text_hash("text").alias("text_hash")], kept)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once, or several times."""
    return mixing.repeat(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row that is left, and whether decoding gave the text back."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Learned scores, fingerprints and tokens can't be written in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
