"""From raw documents to token ids: five stages, each on all that the one before it kept.

1. quality: a byte-level network, trained on the labels, drops documents it rejects.
2. near duplicates: of each class of the n-gram Jaccard join one document stays.
3. private: personal data in the texts is replaced by the name of its kind.
4. mix: documents are taken, repeated or left out so that sources come near their target weights.
5. tokens: texts are encoded, and decoded again for a digest that proves the round trip.

Between stages the rows are a Parquet table in the session's shared folder. Tables may hold nulls,
empty texts, repeated rows and further columns; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blamesplit.llm import bpe, bytenet, jaccard, mixing, private
from blamesplit.llm.registry import table, tokenizer_file
from blamesplit.llm.staging import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is 0.3 or more, with all their columns."""
    net = bytenet.trained(docs, table(spark, sf_dir, "labels"))
    return bytenet.kept(docs, net, 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class of texts linked by similarity 0.8 or more."""
    return jaccard.deduplicated(docs)


def without_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; spans of personal data become <EMAIL>, <IP>, <CARD> or <PHONE>."""
    clean = private.redacted(docs, private.trained(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, or up to three times."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256), a row for each row of the mix."""
    coded = bpe.encode_and_decode(docs, tokenizer_file("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("private", without_private),
    ("mix", mix),
    ("tokens", tokens),
]

#: The first stage's network can't be written in SQL; the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
