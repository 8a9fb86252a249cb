"""The registered queries of this package, with their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blamesplit.llm import alignment, bpe, bytenet, fertility, html, jaccard, merkle, mixing, neighbours, private, sharding, simhash, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """A public vocabulary; $TOKENIZER_DIR names another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


def op4_fertility_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fertility.judged(docs, tokenizer_file("piece_bpe_32k.model"), byte_path=tokenizer_file("byte_bpe_50k.json")).drop("lang", "latin")


def op8_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_bayesian_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op6_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = bytenet.trained(docs, labels.where(_fold("doc_id", 5) != 0))
    return bytenet.scored(docs, net).select(
        "doc_id",
        F.coalesce(_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        "n_chunks",
    )


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), shards=40)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def op1_pruned_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(neighbours.index(vectors), vectors.where(F.col("vec_id") % 100 == 0), 10)


def _fold(doc_id: str, n: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % n


def op2_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.trained(docs, labels.where(_fold("doc_id", 4) != 2))
    found = toxicity.scored(docs, model)
    return found.select(
        "doc_id",
        F.coalesce(_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        *toxicity.FEATURES,
    )


def op3_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op9_layout_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.rendered(table(spark, sf_dir, "pages"))
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def op10_skip_chain_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = private.find_private(docs, private.trained(docs))

    def joined(spans: Column) -> Column:
        said = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(said, ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in private.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op11_identity_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op12_interval_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.col("n_chars") + F.when(_fold("doc_id", 7) == 0, 1).otherwise(0)
    return merkle.Manifest(table(spark, sf_dir, "documents"), found={"n_chars": tampered}).verified()


def op13_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pruned_graph_neighbours": op1_pruned_graph_neighbours,
    "op2_lexicon_toxicity": op2_lexicon_toxicity,
    "op3_threshold_mix": op3_threshold_mix,
    "op4_fertility_bands": op4_fertility_bands,
    "op5_bayesian_jaccard": op5_bayesian_jaccard,
    "op6_byte_network": op6_byte_network,
    "op7_feistel_shards": op7_feistel_shards,
    "op8_forced_boundary_bpe": op8_forced_boundary_bpe,
    "op9_layout_rendering": op9_layout_rendering,
    "op10_skip_chain_private": op10_skip_chain_private,
    "op11_identity_alignment": op11_identity_alignment,
    "op12_interval_manifest": op12_interval_manifest,
    "op13_covering_simhash": op13_covering_simhash,
}

ORACLES: dict[str, str] = {
    "op3_threshold_mix": mixing.ORACLE,
    "op5_bayesian_jaccard": jaccard.ORACLE,
    "op7_feistel_shards": sharding.oracle_sql(),
    "op12_interval_manifest": merkle.ORACLE,
}
