"""Byte-level BPE by overlapping chunks.

A long text is cut into chunks that overlap. Chunks are pre-tokenised independently; where two
neighbours have a pre-token boundary in common inside their overlap, both agree on everything after
it, and the text is cut there. The pieces between cuts are encoded on their own, so a long document
spreads over many tasks. Neighbours without a common boundary (one pre-token longer than the
overlap, say) stay one piece, and so does what follows them in that document.

A cut needs a character that is not white space before it: only white space at the end of a piece
could be split differently by the pattern's look-ahead.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tellwise.llm.base import text_or_empty

CHUNK = 32768
OVERLAP = 512


@lru_cache(maxsize=2)
def encoding(ranks_path: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_PRE_TOKEN = regex.compile(public_tokenizers.PATTERN)


def boundaries(text: str, first: int, last: int) -> list[int]:
    """Ends of pre-tokens of text in [first, last] that follow a character that isn't white space.
    The last pre-token doesn't count: it could go on beyond the chunk."""
    ends, before = [], None
    for match in _PRE_TOKEN.finditer(text):
        if before is not None and first <= before <= last and not text[before - 1].isspace():
            ends.append(before)
        before = match.end()
        if before > last:
            break
    return ends


def _ids(ranks_path: str, text: str) -> bytes:
    return encoding(ranks_path).encode_to_numpy(text).astype("<u4").tobytes()


def _decoded(ranks_path: str, ids: bytes) -> bytes:
    return encoding(ranks_path).decode_bytes(np.frombuffer(ids, "<u4").tolist())


def _encoder(ranks_path: str):
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start:start + 256]
                ids = [_ids(ranks_path, text) for text in part["text"]]
                yield part.drop(columns="text").assign(ids=ids, decoded=[_decoded(ranks_path, x) for x in ids])
    return encode


def _marker(chunk: int, overlap: int):
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(
                head=[boundaries(text, 1, overlap) for text in batch["text"]],
                tail=[[p - chunk for p in boundaries(text, chunk + 1, chunk + overlap)] for text in batch["text"]])
    return mark


def _pieces(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """doc_id, sha, copies, piece, text: long texts cut where neighbouring chunks agree."""
    starts = F.sequence(F.lit(0).cast("long"), F.length("text").cast("long") - 1, F.lit(chunk).cast("long"))
    chunks = (long.select("doc_id", F.sha2("text", 256).alias("sha"), "text", F.posexplode(starts).alias("chunk", "start"))
              .select("doc_id", "sha", "chunk", F.expr(f"substring(text, int(start) + 1, {chunk + overlap})").alias("text"))
              .groupBy("doc_id", "sha", "chunk").agg(F.first("text").alias("text"), F.count("*").alias("copies")))
    marked = chunks.mapInPandas(_marker(chunk, overlap), "doc_id string, sha string, chunk int, text string, copies long, head array<int>, tail array<int>")
    order = Window.partitionBy("doc_id", "sha").orderBy("chunk")
    shared = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A chunk's tail can be trusted only if the chunk itself was entered at a true boundary.
    trusted = F.min((F.col("shared").isNotNull() | (F.col("chunk") == 0)).cast("int")).over(so_far) == 1
    runs = (marked.withColumn("shared", shared).withColumn("cut", F.when(trusted, F.col("shared")))
            .withColumn("next_cut", F.lead("cut").over(order))
            .withColumn("final", F.lead("chunk").over(order).isNull())
            .withColumn("piece", F.count("cut").over(so_far)))
    # A chunk's own part: from its cut (or its start, if it goes on from the one before) to the
    # next one's cut (or the next one's start, if that one goes on from here).
    begin = F.coalesce("cut", F.lit(0))
    stop = F.when(F.col("final"), F.length("text")).otherwise(F.lit(chunk) + F.coalesce("next_cut", F.lit(0)))
    own = runs.select("doc_id", "sha", "copies", "piece", "chunk", F.substring("text", begin + 1, stop - begin).alias("text"))
    return (own.groupBy("doc_id", "sha", "copies", "piece").agg(F.array_sort(F.collect_list(F.struct("chunk", "text"))).alias("parts"))
            .select("doc_id", "sha", "copies", "piece", F.array_join("parts.text", "").alias("text")))


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      ranks_path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers),
    decoded (the bytes of the ids).

    A null text counts as empty and has no ids. Strings of special tokens are ordinary text. Rows
    that repeat give a row each; other columns are not read. ranks_path is the vocabulary as the
    executors see it.
    """
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    whole = rows.where(F.length("text") <= chunk).mapInPandas(_encoder(ranks_path), "doc_id string, ids binary, decoded binary")
    pieces = _pieces(rows.where(F.length("text") > chunk), chunk, overlap)
    coded = pieces.mapInPandas(_encoder(ranks_path), "doc_id string, sha string, copies long, piece long, ids binary, decoded binary")
    joined = (coded.groupBy("doc_id", "sha", "copies").agg(F.array_sort(F.collect_list(F.struct("piece", "ids", "decoded"))).alias("parts"))
              .select("doc_id", "parts", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
              .select("doc_id", *(F.aggregate(f"parts.{c}", F.lit(b""), lambda all_, one: F.concat(all_, one)).alias(c) for c in ("ids", "decoded"))))
    both = whole.unionByName(joined)
    return both.select(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")
