"""Documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its result is
written as Parquet and read again as the next one's docs. All but the last return the columns of
`documents`. A document that loses all its lines keeps its row, with an empty text; equal texts without
words are copies of each other, so the similarity join keeps one of them.

Nulls, in any stage: a null text counts as empty, a null id as an id of its own that comes last, a null
label or benchmark text isn't used, other columns are passed on as they are. Rows that repeat whole stay
or go together, but for the similarity join, which keeps one of them. No documents give no rows; without
a benchmark none is contaminated; without labels every score is one half, which counts as toxic.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellwise.llm.base import shared_folder, table
from tellwise.llm.bpe import encode_and_decode
from tellwise.llm.decontaminate import drop_contaminated
from tellwise.llm.line_dedup import drop_repeated_lines
from tellwise.llm.ngram_join import drop_similar
from tellwise.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each class of near-duplicate lines left once; n_chars counts what is left."""
    cut = drop_repeated_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicate documents."""
    return drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), decoded_sha256."""
    return encode_and_decode(docs).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join),
    ("decontamination", decontamination), ("byte_bpe", byte_bpe),
]

#: SQL can't express the learned score, MinHash candidates or byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the last one's result."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
