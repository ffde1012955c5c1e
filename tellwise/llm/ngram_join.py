"""Similarity join of documents on word five-grams, with Bayesian pruning of candidates.

Documents with equal words are one text (a class of copies). Texts that agree on a band of MinHash
values are candidates. A candidate pair's further MinHash values are compared a few at a time; after
each step the pair is dropped if the probability, given the matches so far and a uniform prior, that
its Jaccard coefficient reaches the threshold is below a tolerance. Pairs that last are verified by
the exact coefficient of their five-gram sets.

Pairs are never rows. The texts of a band's key are compared in one task, or, if they are many, every
two chunks of them in one; what leaves the task is a spanning forest of the pairs that last. Within
the groups that these forests connect, chunk against chunk again, pairs are compared and verified,
and what leaves the task is the number of links of each text and a spanning forest of the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellwise.llm.base import fresh, quoted, settled
from tellwise.llm.components import components
from tellwise.llm.decontaminate import words

GRAM = 5
SIMILARITY = 0.8
#: A pair at the threshold agrees on one of 24 bands of 4 values but for 3 in a million cases.
BANDS, BAND_ROWS = 24, 4
#: Values compared for pruning, a step at a time, and the tolerance.
STEPS, STEP, TOLERANCE = 4, 16, 1e-7
#: Texts of a chunk, on average.
CHUNK_TEXTS = 400


# ------------------------------------------------------------------ shingles and signatures


def shingles(tokens: list[bytes], size: int = GRAM) -> np.ndarray:
    """Sorted 64-bit hashes of a text's word n-grams; a shorter text is one gram, no words none."""
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(tokens) <= size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens))], np.uint64)
    word = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], np.uint64)
    h = np.zeros(len(word) - size + 1, np.uint64)
    for i in range(size):
        h = (h ^ word[i:len(word) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, (2, n), np.uint32)
    return numbers[0], numbers[1] | np.uint32(1)


def signature(grams: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of 32 bits."""
    mask, factor = _constants(n)
    folded = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    parts = [((folded[i:i + 1024, None] ^ mask) * factor).min(0) for i in range(0, len(folded), 1024)]
    return np.minimum.reduce(parts)


def least_matches(steps: int = STEPS, step: int = STEP, similarity: float = SIMILARITY, tolerance: float = TOLERANCE) -> list[int]:
    """After each step, the fewest matches at which the similarity is still possible: where, under a
    uniform prior, the posterior (a beta distribution) leaves at least the tolerance above it."""
    out = []
    for n in range(step, steps * step + 1, step):
        # P(J >= s | m of n) for Beta(m + 1, n - m + 1) is P(Binomial(n + 1, s) <= m).
        total, m = 0.0, 0
        while True:
            total += math.comb(n + 1, m) * similarity ** m * (1 - similarity) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


# ------------------------------------------------------------------ rows of texts


_SIGNED = "doc_id string, text_hash long, words_hash binary, keys array<long>, further binary"


def _signed(size: int, bands: int, band_rows: int, further: int):
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = np.arange(bands, dtype=np.uint32)[:, None]
        for batch in batches:
            hashes, keys, rest = [], [], []
            for text in batch["text"]:
                tokens = words(text)
                # Texts without words are known by all their signs.
                hashes.append(xxhash.xxh3_128_digest(b" ".join(tokens) if tokens else b"\0" + (text or "").encode()))
                if not tokens:
                    keys.append([])
                    rest.append(b"")
                    continue
                values = signature(shingles(tokens, size), bands * band_rows + further)
                banded = np.hstack((number, values[:bands * band_rows].reshape(bands, band_rows))).astype("<u4")
                keys.append([xxhash.xxh3_64_intdigest(row.tobytes()) - (1 << 63) for row in banded])
                rest.append(values[bands * band_rows:].astype("<u2").tobytes())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "words_hash": hashes, "keys": keys, "further": rest})
    return sign


def _sets(size: int):
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens = [words(text) for text in batch["text"]]
            own = np.array([xxhash.xxh3_128_digest(b" ".join(t)) == h for t, h in zip(tokens, batch["words_hash"], strict=True)], bool)
            grams = [shingles(t, size).tobytes() if same else b"" for t, same in zip(tokens, own, strict=True)]
            yield batch.assign(grams=grams).loc[own, ["id", "grams"]]
    return sets


# ------------------------------------------------------------------ comparing


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = top(i), top(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of rows with one (g, l, r); the rows of a task come sorted by these."""
    left = None
    for batch in batches:
        frame = batch if left is None else pd.concat([left, batch], ignore_index=True)
        keys = frame[["g", "l", "r"]].to_numpy()
        bounds = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()]
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            yield frame.iloc[start:end]
        left = frame.iloc[bounds[-1]:]
    if left is not None and len(left):
        yield left


_FOUND = "a long, b long, links long, weight long"


def _comparer(least: list[int], step: int, similarity: float, exact: bool):
    def links(group: pd.DataFrame) -> pd.DataFrame | None:
        own, other = int(group["l"].iloc[0]), int(group["r"].iloc[0])
        ids, first = np.unique(group["id"].to_numpy(), return_index=True)
        group = group.iloc[first]
        chunk, copies = group["chunk"].to_numpy(), group["copies"].to_numpy()
        further = np.stack([np.frombuffer(x, "<u2") for x in group["further"]])
        n = len(ids)
        if exact:
            grams = [np.frombuffer(x, np.uint64) for x in group["grams"]]
            index = np.unique(np.concatenate(grams), return_inverse=True)[1]
            at = np.concatenate(([0], np.cumsum([len(x) for x in grams])))
            size, flag = np.diff(at), np.zeros(len(index), bool)
        count, weight, pairs = np.zeros(n, np.int64), np.zeros(n, np.int64), []
        for i in range(n):
            if chunk[i] != own:
                continue
            j = np.arange(i + 1, n) if own == other else np.flatnonzero(chunk == other)
            matches = np.zeros(len(j), np.int64)
            for k, fewest in enumerate(least):
                part = slice(k * step, (k + 1) * step)
                matches += np.count_nonzero(further[j, part] == further[i, part], axis=1)
                lasting = matches >= fewest
                j, matches = j[lasting], matches[lasting]
            if exact and len(j):
                flag[index[at[i]:at[i + 1]]] = True
                common = np.array([np.count_nonzero(flag[index[at[x]:at[x + 1]]]) for x in j])
                flag[index[at[i]:at[i + 1]]] = False
                j = j[common >= similarity * (size[i] + size[j] - common)]
            if len(j):
                count[i] += len(j)
                weight[i] += copies[j].sum()
                count[j] += 1
                weight[j] += copies[i]
                pairs.append((np.full(len(j), i), j))
        if not pairs:
            return None
        tree = np.array(_forest(n, *map(np.concatenate, zip(*pairs, strict=True))))
        linked = np.flatnonzero(count)
        return pd.DataFrame({"a": np.concatenate((ids[tree[:, 0]], ids[linked])), "b": np.concatenate((ids[tree[:, 1]], ids[linked])),
                             "links": np.concatenate((np.zeros(len(tree), np.int64), count[linked])),
                             "weight": np.concatenate((np.zeros(len(tree), np.int64), weight[linked]))})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, rows = [], 0
        for group in _groups(batches):
            part = links(group)
            if part is not None:
                found.append(part)
                rows += len(part)
            if rows > 20_000:
                yield pd.concat(found)
                found, rows = [], 0
        if found:
            yield pd.concat(found)
    return compare


def _compared(members: DataFrame, chunks: Column, compare) -> DataFrame:
    """members (g, id, ...) in as many chunks for each g, every two of which meet in a task."""
    parts = members.withColumn("chunks", chunks.cast("int")).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(3)), F.col("chunks")).cast("int"))
    paired = (parts.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .withColumn("l", F.least("chunk", "with")).withColumn("r", F.greatest("chunk", "with")).drop("chunks", "with"))
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paired.repartition(partitions, "g", "l", "r").sortWithinPartitions("g", "l", "r").mapInPandas(compare, _FOUND)


def _named(texts: DataFrame) -> DataFrame:
    """texts (words_hash, ...) with an id of their own: a hash, or a second one for the few that share
    the first with another text."""
    named = settled(texts.withColumn("id", F.xxhash64("words_hash")))
    shared = settled(named.groupBy("id").count().where("count > 1").select(F.col("id").alias("twin")))
    if shared.isEmpty():
        return named
    own = F.when(F.col("twin").isNull(), F.col("id")).otherwise(F.xxhash64("id", "words_hash"))
    return settled(named.join(shared, F.col("id") == F.col("twin"), "left").withColumn("id", own).drop("twin"))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = GRAM, similarity: float = SIMILARITY,
                  bands: int = BANDS, band_rows: int = BAND_ROWS, steps: int = STEPS, step: int = STEP, tolerance: float = TOLERANCE,
                  chunk_texts: int = CHUNK_TEXTS) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest doc_id of those connected by links or
    copies), class_size (rows of the class), n_copies (other rows with the same words), n_links
    (different texts linked to this one), n_linked_rows (rows with these texts).

    Words are runs of digits, letters and characters beyond ASCII, in lower case. Texts without
    words are copies of each other if they are equal as they stand (null counts as empty), and linked
    to nothing else. A class has a null id only if all its ids are null. Rows that repeat are copies.
    Other columns are not read; an empty table gives no rows.
    """
    facts = _facts(docs, id_col, text_col, size, similarity, bands, band_rows, steps, step, tolerance, chunk_texts)
    return facts.select("doc_id", "class_id", "class_size", "n_copies", "n_links", "n_linked_rows")


def _facts(docs: DataFrame, id_col: str, text_col: str, size: int = GRAM, similarity: float = SIMILARITY, bands: int = BANDS, band_rows: int = BAND_ROWS,
           steps: int = STEPS, step: int = STEP, tolerance: float = TOLERANCE, chunk_texts: int = CHUNK_TEXTS) -> DataFrame:
    """similar_texts() with text_hash (xxhash64 of the row's text) and root (names the class)."""
    kind = docs.select(quoted(id_col)).schema[0].dataType
    rows = docs.select(quoted(id_col).cast("string").alias("doc_id"), F.xxhash64(quoted(text_col)).alias("text_hash"), quoted(text_col).alias("text"))
    least = least_matches(steps, step, similarity, tolerance)
    signed = settled(rows.mapInPandas(_signed(size, bands, band_rows, steps * step), _SIGNED)
                     .withColumn("doc_id", F.col("doc_id").cast(kind)))
    texts = _named(signed.groupBy("words_hash").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("copies"),
        F.any_value("keys").alias("keys"), F.any_value("further").alias("further")))
    banded = texts.select("id", F.explode("keys").alias("g"))
    shared = banded.groupBy("g").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low <> high").select("g", "n")
    members = banded.join(shared, "g").join(texts.select("id", "copies", "further"), "id")
    lasting = _compared(members, F.ceil(F.col("n") / chunk_texts), _comparer(least, step, similarity, exact=False))
    groups = components(lasting.where("a <> b").select("a", "b"))

    wanted = settled(groups.join(texts, "id").select("id", "root", "first", "copies", "words_hash", "further"))
    # The row that gives a text its first id brings the text itself.
    named = wanted.select("id", "first", "words_hash")
    chosen = rows.join(named, rows["doc_id"].eqNullSafe(named["first"].cast("string"))).select("id", "words_hash", "text")
    sets = chosen.mapInPandas(_sets(size), "id long, grams binary")
    weights = wanted.groupBy("root").agg(F.count("*").alias("n"))
    inside = (sets.join(wanted.select("id", "root", "copies", "further"), "id").join(weights, "root")
              .withColumnRenamed("root", "g"))
    found = settled(_compared(inside, F.ceil(F.col("n") / chunk_texts), _comparer(least, step, similarity, exact=True)))
    classes = components(found.where("a <> b").select("a", "b"))
    counts = found.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("n_links"), F.sum("weight").alias("n_linked_rows"))
    known = (texts.select("id", "words_hash", "first", "copies").join(classes, "id", "left").withColumn("root", F.coalesce("root", "id")).join(counts, "id", "left"))
    whole = known.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    none = F.lit(0).cast("long")
    facts = known.join(whole, "root").select(
        "words_hash", "root", "class_id", "class_size", (F.col("copies") - 1).alias("n_copies"), F.coalesce("n_links", none).alias("n_links"),
        F.coalesce("n_linked_rows", none).alias("n_linked_rows"))
    return signed.select("doc_id", "text_hash", "words_hash").join(facts, "words_hash").drop("words_hash")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs, all columns, with one row of each class of similar texts: that with the smallest id (null
    comes last), of rows with one id that with the least hash of its text; one of several rows with
    that id and text, any one if they differ in other columns. Texts without words and null texts are
    treated as in similar_texts(). Columns may have any names; an empty table gives no rows."""
    rows = _facts(docs, id_col, text_col, **how).groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash", "rows")).alias("kept")
    own, hashed = fresh(docs, "kept_id", "kept_hash")
    kept = settled(rows.groupBy("root").agg(least).select(F.col("kept.doc_id").alias(own), F.col("kept.text_hash").alias(hashed), F.col("kept.rows").alias("rows")))
    text_hash = F.xxhash64(quoted(text_col))

    def among(wanted: DataFrame) -> DataFrame:
        return docs.join(wanted.select(own, hashed), quoted(id_col).eqNullSafe(F.col(own)) & (text_hash == F.col(hashed)), "left_semi")

    repeated = kept.where("rows > 1")
    if repeated.isEmpty():
        return among(kept)
    once = among(repeated).withColumn(own, quoted(id_col)).withColumn(hashed, text_hash).dropDuplicates([own, hashed]).drop(own, hashed)
    return among(kept.where("rows = 1")).union(once)
