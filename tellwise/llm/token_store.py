"""Token ids on disk, and a minimal perfect hash index for keyed access.

A store is a folder:

* `shard-00000.bin`: ids as little-endian unsigned integers, document after document in ascending
  key order, each closed by the end id; of 16 bits if the vocabulary fits, else of 32;
* `shard-00000.idx`: n + 1 little-endian unsigned 64-bit integers, where documents begin in the
  shard (in ids) and where the last one ends;
* `index-00000.npz`: for the keys of one hash part, a minimal perfect hash (bit arrays of several
  levels, and ranks) from key to slot; a slot has the key's fingerprint, shard, place, offset and
  length (in ids) of its first document, and its number of documents (keys may repeat).

A key is found in constant time: its hash part, its slot, the fingerprint compared, one read at the
slot's offset in the slot's shard. Further documents of a key follow the first one, into the next
shards if need be; their offsets come from the shards' own lists. The fingerprint has 32 bits, so a
key that the store does not hold is taken for another once in 2**32 times.

Files are written under a name of their own and then moved, so a task that runs twice leaves the
same file. All of them are in a folder that driver and executors share.
"""

from __future__ import annotations

import hashlib
import io
import math
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellwise.llm.base import as_uri, open_folder, settled, shared_folder, text_or_empty

END_ID = 0
SHARD_BYTES = 32 << 20
INDEX_KEYS = 1 << 16

# ------------------------------------------------------------------ encoding


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


class Encoder:
    """Encodes texts as the library does; pieces that were met before come from memory.

    A pre-token always ends where a letter is followed by something else, and where something that
    isn't blank is followed by a blank or line feed. Pieces between such places can be encoded
    alone, and new pieces that begin with a blank and end with a letter can be encoded in a row, a
    line each, as a line feed before a blank is a token of its own; a call for each piece would cost
    more than the merges. Texts with other white space, letters beyond Latin-1 or the text of an added token
    (which the library finds before it splits) are encoded whole.

    Memory has two generations: when the younger one is full it becomes the older one, and a piece
    that is met again moves to the younger.
    """

    PIECE = re.compile(r"[ \n]*(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[^A-Za-zÀ-ÖØ-öø-ÿ \n]+[A-Za-zÀ-ÖØ-öø-ÿ]*)|[ \n]+")
    #: Latin-1 characters that the pieces are known for.
    USUAL = re.sub("[^\n\x20-\x7EÀ-ÖØ-öø-ÿ¡¿«»]", "", "".join(map(chr, range(256)))).encode("latin-1")
    IN_A_ROW = re.compile(r" [^ \n]*[A-Za-zÀ-ÖØ-öø-ÿ]")
    REMEMBERED, LONGEST, CHARS, ROW = 500_000, 48, 1 << 21, 512

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = id_type(self.tokenizer.get_vocab_size())
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _other(self, text: str) -> bool:
        try:
            unusual = text.encode("latin-1").translate(None, self.USUAL)
        except UnicodeEncodeError:
            return True
        return bool(unusual) or any(token in text for token in self.added)

    def _learn(self, pieces: list[str]) -> None:
        row = list(filter(self.IN_A_ROW.fullmatch, pieces)) if len(self.feed) == 1 else []
        alone = list(set(pieces).difference(row))
        self.known.update(zip(alone, self._whole(alone), strict=True))
        groups = [row[at:at + self.ROW] for at in range(0, len(row), self.ROW)]
        width = self.kind.itemsize
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(["\n".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.kind)
            data, feeds = ids.tobytes(), np.flatnonzero(ids == self.feed[0])
            begins, ends = [0, *((feeds + 1) * width).tolist()], [*(feeds * width).tolist(), len(data)]
            self.known.update(zip(group, map(data.__getitem__, map(slice, begins, ends)), strict=True))

    def _chunk(self, texts: list[str]) -> list[bytes]:
        split = [None if self._other(t) else self.PIECE.findall(t) for t in texts]
        if len(self.known) > self.REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        missing = set().union(*filter(None, split)).difference(known)
        met = missing.intersection(older)
        known.update((piece, older[piece]) for piece in met)
        new = list(missing.difference(met))
        self._learn(new)
        whole, remembered = iter(self._whole([t for t, x in zip(texts, split) if x is None])), known.__getitem__
        out = [next(whole) if x is None else b"".join(map(remembered, x)) for x in split]
        for piece in new:
            if len(piece) > self.LONGEST:
                del known[piece]
        return out

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as bytes."""
        chunk, chars = [], 0
        for text in texts:
            chunk.append(text)
            chars += len(text)
            if chars >= self.CHARS:
                yield from self._chunk(chunk)
                chunk, chars = [], 0
        yield from self._chunk(chunk)


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


# ------------------------------------------------------------------ files


def _put(folder: str, name: str, data: bytes) -> None:
    files, root = open_folder(folder)
    own = f"{root}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write(data)
    files.move(own, f"{root}/{name}")


def _get(folder: str, name: str) -> bytes:
    files, root = open_folder(folder)
    with files.open_input_stream(f"{root}/{name}") as file:
        return file.read()


def _shard_writer(folder: str, tokenizer_path: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, encode = TaskContext.get().partitionId(), _encoder(tokenizer_path)
        files, root = open_folder(folder)
        name, own = f"shard-{shard:05}", f".shard-{shard:05}-{uuid.uuid4().hex}"
        end, width, offsets = np.array([END_ID], encode.kind).tobytes(), encode.kind.itemsize, [0]
        with files.open_output_stream(f"{root}/{own}") as out:
            for batch in batches:
                first = len(offsets) - 1
                for ids in encode(batch["text"]):
                    ids += end
                    out.write(ids)
                    offsets.append(offsets[-1] + len(ids) // width)
                yield pd.DataFrame({"key": batch["key"], "shard": shard, "place": np.arange(first, first + len(batch)),
                                    "offset": offsets[first:first + len(batch)], "n_tokens": np.diff(offsets[first:first + len(batch) + 1])})
        files.move(f"{root}/{own}", f"{root}/{name}.bin")
        _put(folder, f"{name}.idx", np.array(offsets, "<u8").tobytes())
    return write


# ------------------------------------------------------------------ minimal perfect hash


def _digests(keys: list[str]) -> np.ndarray:
    raw = b"".join(hashlib.blake2b(key.encode(), digest_size=24).digest() for key in keys)
    return np.frombuffer(raw, "<u8").reshape(-1, 3)


def _position(digests: np.ndarray, level: int, size: int) -> np.ndarray:
    h = digests[:, 0] + digests[:, 1] * np.uint64(2 * level + 1)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(11)) % np.uint64(size)


class PerfectHash:
    """Level by level, a key that has a bit of an array to itself takes it; the others go on to the
    next, smaller array. A key's slot is the number of set bits before its own."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.begins = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.rank = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))

    @classmethod
    def of(cls, digests: np.ndarray) -> PerfectHash:
        sizes, arrays, rest = [], [], digests
        while len(rest):
            if len(sizes) == 100:
                raise ValueError("two keys have the same digest")
            at = _position(rest, len(sizes), size := 2 * len(rest) + 1)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            arrays.append(alone)
            rest = rest[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(arrays) if arrays else np.zeros(0, bool))

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Slots of the keys; -1 for those that certainly aren't held."""
        out, rest = np.full(len(digests), -1, np.int64), np.arange(len(digests))
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = self.begins[level] + _position(digests[rest], level, int(size)).astype(np.int64)
            found = self.bits[at]
            out[rest[found]] = self.rank[at[found]]
            rest = rest[~found]
        return out


_FINGERPRINT = np.uint64(0xFFFFFFFF)
#: What a slot tells of a key.
_SLOT = ["shard", "place", "offset", "n_tokens", "rows"]


def _index_writer(folder: str):
    def write(group: pd.DataFrame) -> pd.DataFrame:
        part, digests = int(group["part"].iloc[0]), _digests(list(group["key"]))
        perfect = PerfectHash.of(digests)
        slots = perfect.slots(digests)
        order = np.argsort(slots)
        data = io.BytesIO()
        np.savez(data, sizes=perfect.sizes, bits=np.packbits(perfect.bits), fingerprint=(digests[order, 2] & _FINGERPRINT).astype("<u4"),
                 **{c: group[c].to_numpy("<i8")[order] for c in _SLOT})
        _put(folder, f"index-{part:05}.npz", data.getvalue())
        return pd.DataFrame({"part": [part], "keys": [len(group)]})
    return write


def _finder(folder: str):
    def find(group: pd.DataFrame) -> pd.DataFrame:
        with np.load(io.BytesIO(_get(folder, f"index-{int(group['part'].iloc[0]):05}.npz"))) as data:
            sizes, fingerprint, slot = data["sizes"], data["fingerprint"], {c: data[c] for c in _SLOT}
            bits = np.unpackbits(data["bits"], count=int(sizes.sum())).astype(bool)
        digests = _digests(list(group["key"]))
        slots = PerfectHash(sizes, bits).slots(digests)
        held = slots >= 0
        held[held] = fingerprint[slots[held]] == (digests[held, 2] & _FINGERPRINT)
        found = group[held]
        return pd.DataFrame({"key": found["key"], **{c: slot[c][slots[held]] for c in _SLOT}})
    return find


# ------------------------------------------------------------------ store


@dataclass(frozen=True)
class TokenStore:
    """A store that has been written. `shards` has a row for each shard: number, first document,
    first id."""

    folder: str
    shards: tuple[tuple[int, int, int], ...]
    parts: int
    kind: np.dtype

    def _part(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.parts)).cast("int")

    def find(self, keys: DataFrame) -> DataFrame:
        """key, shard, place, offset, n_tokens, rows for those of the distinct keys (column `key`, string)
        that the store holds: where its first document is, and its number of documents."""
        return keys.withColumn("part", self._part()).groupBy("part").applyInPandas(_finder(self.folder), "key string, shard long, place long, offset long, n_tokens long, rows long")

    def read(self, keys: DataFrame) -> DataFrame:
        """key, number, start (in ids, in the whole store), ids (little-endian unsigned 32-bit integers) of each document that the
        store holds under one of the distinct keys."""
        shards = np.array(self.shards, np.int64).reshape(-1, 3)
        folder, kind = self.folder, self.kind

        def row_of(shard: pd.Series) -> np.ndarray:
            return np.searchsorted(shards[:, 0], shard)

        def following(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                number = shards[row_of(batch["shard"]), 1] + batch["place"] + batch["step"]
                row = np.searchsorted(shards[:, 1], number, side="right") - 1
                yield pd.DataFrame({"key": batch["key"], "shard": shards[row, 0], "place": number - shards[row, 1], "offset": -1, "n_tokens": -1})

        def payload(group: pd.DataFrame) -> pd.DataFrame:
            shard = group["shard"].iloc[0]
            name, row = f"shard-{shard:05}", shards[int(row_of(shard))]
            group = group.sort_values("place")
            begin, length = group["offset"].to_numpy(), group["n_tokens"].to_numpy()
            if (begin < 0).any():
                offsets = np.frombuffer(_get(folder, f"{name}.idx"), "<u8").astype(np.int64)
                begin = offsets[group["place"]]
                length = offsets[group["place"] + 1] - begin
            files, root = open_folder(folder)
            with files.open_input_file(f"{root}/{name}.bin") as file:
                raw = [file.read_at(kind.itemsize * n, kind.itemsize * at) for at, n in zip(begin.tolist(), length.tolist(), strict=True)]
            ids = [np.frombuffer(x, kind).astype("<u4").tobytes() for x in raw]
            return pd.DataFrame({"key": group["key"], "number": row[1] + group["place"], "start": row[2] + begin, "ids": ids})

        found = self.find(keys)
        first = found.select("key", "shard", "place", "offset", "n_tokens")
        steps = found.where("rows > 1").select("key", "shard", "place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows") - 1)).alias("step"))
        located = first.union(steps.mapInPandas(following, "key string, shard long, place long, offset long, n_tokens long"))
        return located.groupBy("shard").applyInPandas(payload, "key string, number long, start long, ids binary")


def write_store(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                tokenizer_path: str | None = None, shard_bytes: int = SHARD_BYTES, index_keys: int = INDEX_KEYS) -> TokenStore:
    """Encodes docs, writes a store and returns it.

    Documents are in ascending order of id (null first), rows of one id in order of a
    hash of their texts. A
    null text counts as empty: only the end id is written for it. The text of an added token
    becomes its id, as the library has it. A null id has the key "null", any other id "id:" and its text. An id that repeats has one key
    and several documents. Other columns are not read; no rows make a store without shards.
    """
    spark = docs.sparkSession
    folder = folder or f"{as_uri(shared_folder(spark))}/token-store-{uuid.uuid4().hex}"
    files, root = open_folder(folder)
    files.create_dir(root, recursive=True)
    tokenizer_path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    n_rows, n_bytes = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    shards = max(1, math.ceil((n_bytes or 0) / shard_bytes))
    dealt = (rows.repartitionByRange(shards, "id", "tie").sortWithinPartitions("id", "tie", "text")
             .select(_key("id").alias("key"), "text"))
    written = settled(dealt.mapInPandas(_shard_writer(folder, tokenizer_path), "key string, shard int, place long, offset long, n_tokens long"))
    table, documents, ids = [], 0, 0
    # One row for each shard file comes to the driver.
    for shard, n_documents, n_ids in sorted(map(tuple, written.groupBy("shard").agg(F.count("*"), F.sum("n_tokens")).collect())):
        table.append((shard, documents, ids))
        documents, ids = documents + n_documents, ids + n_ids
    store = TokenStore(folder, tuple(table), max(1, math.ceil(n_rows / index_keys)), _encoder(tokenizer_path).kind)
    first = F.min(F.struct("shard", "place", "offset", "n_tokens")).alias("first")
    keys = written.groupBy("key").agg(first, F.count("*").alias("rows")).select("key", "first.*", "rows").withColumn("part", store._part())
    indexed = keys.groupBy("part").applyInPandas(_index_writer(folder), "part int, keys long")
    indexed.agg(F.sum("keys")).collect()
    return store


def _key(id_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("id:"), F.col(id_col).cast("string")), F.lit("null"))


def documents_of(store: TokenStore, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the store whose id docs has, from the
    store's files."""
    kind = docs.schema[id_col].dataType
    keys = docs.select(_key(id_col).alias("key")).distinct()
    doc_id = F.when(F.col("key") != "null", F.substring("key", 4, 2147483647)).cast(kind).alias("doc_id")
    return store.read(keys).select(doc_id, "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def stored_documents(docs: DataFrame, **how) -> DataFrame:
    """Writes a store of docs (see write_store) and reads every document back by its key."""
    return documents_of(write_store(docs, **how), docs, how.get("id_col", "doc_id"))
