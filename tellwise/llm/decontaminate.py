"""Benchmark decontamination by Wu-Manber search over words.

Patterns are windows of 13 consecutive words of a benchmark item (an item of fewer words is one
window). Windows of one length share a table: a block of two words tells how far the search may jump
(`shift`); a block that can end a window has shift 0 and selects the bucket of windows that end so;
each window of the bucket is then compared word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellwise.llm.base import fresh, quoted

WINDOW = 13
#: Most bytes of benchmark text that one pass holds in a task; more is searched in several passes.
PASS_BYTES = 16 << 20

_UPPER = range(ord("A"), ord("Z") + 1)
_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes((c + 32 if c in _UPPER else c) if c in _WORD or c in _UPPER else 0x20 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z in lower case, as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


@dataclass
class Table:
    """Shift table and buckets for windows of one length."""

    length: int
    shift: dict = field(default_factory=dict)
    bucket: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.block = min(2, self.length)
        self.farthest = self.length - self.block + 1

    def add(self, window: list[bytes], item: str) -> None:
        for end in range(self.block, self.length + 1):
            block = tuple(window[end - self.block:end])
            self.shift[block] = min(self.shift.get(block, self.farthest), self.length - end)
        self.bucket.setdefault(tuple(window[-self.block:]), {}).setdefault(tuple(window), set()).add(item)

    def search(self, text: list[bytes], hits: list[tuple[int, int]], items: set[str]) -> None:
        shift, farthest, block, length = self.shift, self.farthest, self.block, self.length
        end = length
        while end <= len(text):
            last = tuple(text[end - block:end])
            step = shift.get(last, farthest)
            if step:
                end += step
                continue
            found = self.bucket[last].get(tuple(text[end - length:end]))
            if found:
                hits.append((end - length, end))
                items |= found
            end += 1


def tables(items: list[tuple[str, str]], window: int = WINDOW) -> list[Table]:
    """Search tables of (item id, text) pairs, one for each length of window."""
    by_length: dict[int, Table] = {}
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        if size:
            table = by_length.setdefault(size, Table(size))
            for start in range(len(own) - size + 1):
                table.add(own[start:start + size], item)
    return list(by_length.values())


def _blocks(benchmark: DataFrame, limit: int) -> list[DataFrame]:
    """benchmark in parts of at most limit bytes of text, or single hash values of rows."""
    size = F.sum(F.octet_length("text")).alias("bytes")
    total = benchmark.agg(size).first()["bytes"] or 0
    n = max(1, math.ceil(total / limit))
    if n == 1:
        return [benchmark]
    part = F.pmod(F.xxhash64("item", "text"), F.lit(2 * n))
    return [benchmark.where(part == i) for i in range(2 * n)]


_FOUND = "doc_id string, text_hash long, n_words long, starts array<int>, ends array<int>, items array<string>"


def _searcher(parts):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text_hash, text in zip(batch["doc_id"], batch["text_hash"], batch["text"], strict=True):
                own, hits, items = words(text), [], set()
                for table in parts.value:
                    table.search(own, hits, items)
                rows.append((doc, text_hash, len(own), [h[0] for h in hits], [h[1] for h in hits], sorted(items)))
            yield pd.DataFrame(rows, columns=list(batch.columns[:2]) + ["n_words", "starts", "ends", "items"])
    return search


def _merged(passes: list[DataFrame]) -> DataFrame:
    """The rows of several passes over the same documents as one row per document."""
    both = passes[0].withColumn("pass", F.lit(0))
    for i, one in enumerate(passes[1:], 1):
        both = both.unionByName(one.withColumn("pass", F.lit(i)))
    first = [F.first(c).alias(c) for c in ("n_words", "starts", "ends", "items")]
    once = both.groupBy("doc_id", "text_hash", "pass").agg(*first, F.count("*").alias("copies"))
    joined = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")]
    return (once.groupBy("doc_id", "text_hash").agg(F.first("n_words").alias("n_words"), *joined, F.max("copies").alias("copies"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy"))


def occurrences(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, text_hash (xxhash64 of the text), n_words, starts and ends
    (in words) of the windows that occur, items they come from.

    Null texts have no words; a null item id is named "null". Items that share an id count as one.
    Rows of docs that repeat give a row each; other columns are not read. Without benchmark rows
    nothing occurs. A pass holds at most about pass_bytes of benchmark text (or one longer item), so
    neither the driver's nor a task's memory grows with the benchmark.
    """
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
        F.col(item_text_col).alias("text")).where("text is not null").distinct()
    source = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    context = docs.sparkSession.sparkContext
    passes = []
    for block in _blocks(items, pass_bytes):
        parts = context.broadcast(tables([(r["item"], r["text"]) for r in block.toLocalIterator()], window))
        passes.append(source.mapInPandas(_searcher(parts), _FOUND))
    found = passes[0] if len(passes) == 1 else _merged(passes)
    return found.select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"), "text_hash", "n_words", "starts", "ends",
        F.array_sort(F.array_distinct("items")).alias("items"))


def _covered(starts: str, ends: str) -> Column:
    """Number of positions inside at least one [start, end)."""
    spans = F.array_sort(F.arrays_zip(F.col(starts).alias("start"), F.col(ends).alias("end")))
    none = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("reach"))

    def add(so_far: Column, span: Column) -> Column:
        new = F.greatest(F.lit(0), span["end"] - F.greatest(span["start"], so_far["reach"]))
        return F.struct((so_far["total"] + new).alias("total"), F.greatest(so_far["reach"], span["end"]).alias("reach"))

    return F.aggregate(spans, none, add)["total"]


def contamination(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, n_words, n_hit, n_items, items, contaminated. A document is
    contaminated if at least a twentieth of its words lie in occurring windows (and at least one).
    Parameters and special cases as in occurrences()."""
    found = occurrences(docs, benchmark, **names).withColumn("n_hit", _covered("starts", "ends"))
    return found.select(
        "doc_id", "text_hash", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs, all columns, without the contaminated rows. Rows with null or empty texts stay, with null
    ids too; rows that repeat stay or go together; columns may have any names; no rows give no rows,
    and without benchmark rows all stay."""
    own, hashed = fresh(docs, "bad_id", "bad_hash")
    bad = (contamination(docs, benchmark, id_col=id_col, text_col=text_col, **how).where("contaminated")
           .select(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed)).distinct())
    same = quoted(id_col).eqNullSafe(F.col(own)) & (F.xxhash64(quoted(text_col)) == F.col(hashed))
    return docs.join(bad, same, "left_anti")
