"""Repeated passages: every window of 35 consecutive words that also starts elsewhere is removed.

Documents are dealt by hash into blocks of a few megabytes. A block hashes all its windows by Rabin
and Karp's rolling polynomial, keeps each value once and sends the values to buckets (a second,
independent hash gives the bucket). A bucket counts in how many blocks each value occurs and answers
every block with one bit for each value it sent. The block, hashing its texts again, then knows for
each window whether it repeats inside the block or beyond, and joins such windows into maximal
intervals.

A window that occurs in a third of all documents reaches its bucket once for each block, not once
for each document. What travels is the text (once, to its block), 8 bytes for each distinct window
of a block, and the bits. Two windows are the same if their 64-bit values and their buckets' values
agree.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 35
#: Bytes of text in a block, on average; a longer document is a block of its own size.
BLOCK_BYTES = 4 << 20
#: Windows that a bucket gets, about.
BUCKET_WINDOWS = 1 << 20

_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Longer words are hashed one by one: polynomials modulo 2**64 have known collisions from about
#: a thousand terms on.
_LONG_WORD = 512
_MASK = (1 << 64) - 1


def _mixed(x: int) -> int:
    """A fixed pseudo-random number for x (the finaliser of SplitMix64)."""
    x = (x + 0x9E3779B97F4A7C15) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """One of the two independent hashes: of words, and of windows of words."""

    def __init__(self, seed: int) -> None:
        self.letters = np.array([_mixed(seed * 1000 + i) for i in range(256)], np.uint64)
        self.base, self.step = _mixed(seed * 1000 + 256) | 1, _mixed(seed * 1000 + 257) | 1
        self.salt = seed.to_bytes(4, "little")

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * _powers(self.base, len(data)), out=sums[1:])
        back = _powers(pow(self.base, -1, 1 << 64), len(data))
        out = _spread((sums[ends] - sums[starts]) * back[starts])
        for i in np.flatnonzero(ends - starts > _LONG_WORD):
            word = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8, salt=self.salt).digest()
            out[i] = int.from_bytes(word, "little")
        return out

    def windows(self, words: np.ndarray, size: int) -> np.ndarray:
        """The polynomial of each `size` consecutive values, put together from halves."""
        part, width, out, have = words, 1, None, 0
        while True:
            if size & width:
                rest = part[have:]
                out = rest if out is None else out[:len(rest)] * np.uint64(pow(self.step, width, 1 << 64)) + rest[:len(out)]
                have += width
            if have == size:
                return _spread(out[:max(0, len(words) - size + 1)])
            part = part[:-width] * np.uint64(pow(self.step, width, 1 << 64)) + part[width:] if len(part) > width else part[:0]
            width *= 2


_FIRST, _SECOND = Hasher(1), Hasher(2)


class Block:
    """The windows of some texts: `value` and `place` (for the bucket) of each distinct one in
    sorted order, `index` from a window to its distinct one, `count` inside the block."""

    def __init__(self, texts: list[bytes | None], size: int) -> None:
        joined = b" ".join(t or b"" for t in texts)
        data = np.frombuffer(joined, np.uint8)
        filled = np.concatenate(([False], ~_BLANK[data], [False])) if len(data) else np.zeros(2, bool)
        edges = np.flatnonzero(filled[1:] != filled[:-1])
        starts, ends = edges[::2], edges[1::2]
        begins = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
        self.first = np.searchsorted(starts, begins)  # of each text's words; one more at the end
        n = len(starts)
        left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(n)
        self.start = np.flatnonzero(left >= size)
        if not len(self.start):
            self.value = self.place = np.zeros(0, np.uint64)
            self.index = self.count = np.zeros(0, np.int64)
            return
        a = _FIRST.windows(_FIRST.words(data, starts, ends), size)[self.start]
        b = _SECOND.windows(_SECOND.words(data, starts, ends), size)[self.start]
        order = np.lexsort((b, a))
        new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
        self.index = np.empty(len(order), np.int64)
        self.index[order] = np.cumsum(new) - 1
        self.count = np.bincount(self.index)
        self.value, self.place = a[order][new], b[order][new]

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct windows in order of their bucket, and where each bucket begins."""
        bucket = (self.place >> np.uint64(11)) % np.uint64(n)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(n + 1, dtype=np.uint64))


_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("values", pa.binary())])
_ANSWER = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])


def _sender(size: int, n_buckets: int):
    def send(group: pa.Table) -> pa.Table:
        block = Block(group["body"].to_pylist(), size)
        order, at = block.buckets(n_buckets)
        values = block.value[order]
        used = np.flatnonzero(at[1:] > at[:-1])
        return pa.table([used, [group["block"][0].as_py()] * len(used), [values[at[i]:at[i + 1]].tobytes() for i in used]], schema=_SENT)
    return send


def _count(group: pa.Table) -> pa.Table:
    """For each block's values one bit: does another block have it too?"""
    sent = [np.frombuffer(x, np.uint64) for x in group["values"].to_pylist()]
    every = np.concatenate(sent)
    order = np.argsort(every, kind="stable")
    ranked, sender = every[order], np.repeat(np.arange(len(sent)), [len(x) for x in sent])[order]
    same = (ranked[1:] == ranked[:-1]) & (sender[1:] != sender[:-1])
    repeats = np.empty(len(every), bool)
    repeats[order] = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    parts = np.split(repeats, np.cumsum([len(x) for x in sent])[:-1])
    return pa.table([group["block"], group["bucket"], [np.packbits(x).tobytes() for x in parts]], schema=_ANSWER)


_RESULT = "doc_id string, n_words long, n_removed long, starts array<int>, ends array<int>, kept string"


def _remover(size: int, n_buckets: int):
    schema = pa.schema([("doc_id", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                        ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("kept", pa.string())])

    def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = docs["body"].to_pylist()
        block = Block(texts, size)
        order, at = block.buckets(n_buckets)
        beyond = np.zeros(len(block.value), bool)
        for bucket, bits in zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True):
            own = order[at[bucket]:at[bucket + 1]]
            beyond[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
        repeated = block.start[(beyond | (block.count > 1))[block.index]] if len(block.start) else block.start
        change = np.zeros(block.first[-1] + 1, np.int64)
        np.add.at(change, repeated, 1)
        np.add.at(change, repeated + size, -1)
        gone = np.cumsum(change)[:-1] > 0
        rows = []
        for i, text in enumerate(texts):
            own = gone[block.first[i]:block.first[i + 1]]
            edges = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
            words = (text or b"").split()
            kept = compress(words, ~own) if len(edges) else words
            rows.append((len(own), int(own.sum()), edges[::2], edges[1::2], b" ".join(kept).decode()))
        return pa.table([docs["doc_id"].to_pylist(), *map(list, zip(*rows, strict=True))], schema=schema)
    return remove


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                      block_bytes: int = BLOCK_BYTES, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, starts and ends (in words) of the
    maximal intervals that go, kept (the other words, joined by one space).

    Words are runs of characters other than [\\x20\\x09-\\x0D]. A null text has no words; a text of
    fewer words than the window loses none. Rows that repeat are occurrences of their own. Windows
    are judged on the input. Other columns are not read; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    size = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    n_buckets = max(1, math.ceil(size / 7 / bucket_windows))
    block = F.pmod(F.xxhash64("doc_id", "body"), F.lit(n_blocks)).cast("int")
    dealt = rows.withColumn("block", block)
    sent = dealt.groupBy("block").applyInArrow(_sender(window, n_buckets), "bucket int, block int, values binary")
    answers = sent.groupBy("bucket").applyInArrow(_count, "block int, bucket int, bits binary")
    found = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_remover(window, n_buckets), _RESULT)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
