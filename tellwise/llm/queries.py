"""The registered queries: each operator over its whole table, reduced to the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tellwise.llm.base import table
from tellwise.llm.bpe import encode_and_decode
from tellwise.llm.decontaminate import contamination
from tellwise.llm.exact_dedup import exact_groups
from tellwise.llm.hard_negatives import hard_negatives
from tellwise.llm.line_dedup import line_decisions
from tellwise.llm.merkle import document_manifest, verified_leaves
from tellwise.llm.ngram_join import similar_texts
from tellwise.llm.pii import KINDS, personal_data
from tellwise.llm.sharding import shard_places
from tellwise.llm.substring_dedup import repeated_passages
from tellwise.llm.token_store import stored_documents
from tellwise.llm.toxicity import toxicity_scores
from tellwise.llm.warc import archived_pages


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document."""
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels that aren't held out."""
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five-grams of words, similarity 0.8."""
    return similar_texts(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to."""
    coded = encode_and_decode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document outside and inside repeated passages."""
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and ids in a token store, read back from its files by key."""
    return stored_documents(table(spark, sf_dir, "documents"))


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record that was converted from ARC."""
    return archived_pages(table(spark, sf_dir, "pages"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: what the rules find, and all spans."""
    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(number, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document that go, as near-duplicates of a line that stays."""
    return line_decisions(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under a permutation of row numbers."""
    places = shard_places(table(spark, sf_dir, "documents"))
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return places.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document in the manifest, some of them tampered with."""
    proved = verified_leaves(document_manifest(table(spark, sf_dir, "documents")))
    return proved.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every anchor and positive."""
    return hard_negatives(table(spark, sf_dir, "embeddings"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination, "op2_exact_dedup": op2_exact_dedup, "op3_toxicity": op3_toxicity, "op4_ngram_join": op4_ngram_join,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_substring_dedup": op6_substring_dedup, "op7_token_store": op7_token_store, "op8_arc_to_warc": op8_arc_to_warc,
        "op9_personal_data": op9_personal_data, "op10_line_dedup": op10_line_dedup,
        "op11_sharding": op11_sharding, "op12_merkle_manifest": op12_merkle_manifest, "op13_hard_negatives": op13_hard_negatives,
    }
