"""Decontamination, exact deduplication, repeated passages and byte-level BPE against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tellwise.llm.bpe import encode_and_decode, encoding
from tellwise.llm.decontaminate import contamination, drop_contaminated
from tellwise.llm.exact_dedup import drop_exact_duplicates, exact_groups
from tellwise.llm.substring_dedup import Block, repeated_passages


def _rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# ------------------------------------------------------------------ decontamination


def _words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def _contamination(docs, items):
    windows = {}
    for item, text in items:
        w = _words(text)
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[s:s + k]), set()).add("null" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = _words(text), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s:s + k]) in windows:
                    hit.update(range(s, s + k))
                    found |= windows[tuple(w[s:s + k])]
        out.append((doc, len(w), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("pass_bytes", [1 << 20, 150])
def test_contamination(spark, pass_bytes):
    rnd = random.Random(4)
    some = ["ab", "é", "c1", "DE", "日本", "f"]

    def text(n):
        return "".join(rnd.choice(some) + rnd.choice([" ", ", ", "\n", "-"]) for _ in range(n))

    items = [(i, text(rnd.choice([1, 2, 5, 13, 14, 30]))) for i in range(12)] + [(3, text(20)), (None, text(15)), (50, None), (51, "..."), (52, "")]
    docs = [(i, text(rnd.randint(0, 60)) + rnd.choice(items[:12])[1][:200] + text(40) if i % 2 else text(30)) for i in range(40)]
    docs += [(90, None), (91, ""), (None, docs[1][1]), (1, docs[1][1]), (1, docs[1][1])]
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated")
    found = contamination(frame, bench, pass_bytes=pass_bytes)
    assert _rows(found, *names) == _contamination(docs, items)
    bad = {(d, t) for (d, t) in docs for r in _contamination([(d, t)], items) if r[5]}
    assert _rows(drop_contaminated(frame, bench), "doc_id", "text") == sorted((x for x in docs if x not in bad), key=str)
    assert contamination(frame.limit(0), bench).count() == 0
    assert contamination(frame, bench.limit(0)).where("n_hit > 0").count() == 0


# ------------------------------------------------------------------ exact duplicates


def test_exact_groups(spark):
    rows = [(5, "a b"), (2, "ab"), (9, "a  b"), (7, "a\tb "), (1, None), (3, ""), (4, " \n"), (None, "ab"), (6, "é x"), (8, "éx"),
            (10, "A b"), (10, "A b"), (11, "x y"), (12, "xy")]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, body string")

    def body(t):
        return re.sub(r"[\x20\x09-\x0D]", "", t or "")

    want = []
    for d, t in rows:
        group = [(-len(x or ""), i is None, i or 0, i) for i, x in rows if body(x) == body(t)]
        best = min(group)
        want.append((d, best[3], len(group), d == best[3] and -len(t or "") == best[0], hashlib.sha256(body(t).encode()).hexdigest()))
    assert _rows(exact_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=str)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {w[0] for w in want if w[3]}
    assert exact_groups(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ repeated passages


def _passages(rows, size):
    seen = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for n, w in enumerate(split):
        for s in range(len(w) - size + 1):
            seen.setdefault(tuple(w[s:s + size]), []).append((n, s))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for n, s in places:
                gone[n].update(range(s, s + size))
    return sorted(((d, len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for (d, _), w, g in zip(rows, split, gone, strict=True)), key=str)


@pytest.mark.parametrize("size, block, bucket", [(35, 1 << 20, 1 << 20), (5, 600, 40), (1, 300, 16), (8, 1, 1)])
def test_repeated_passages(spark, size, block, bucket):
    rnd = random.Random(size)
    some = ["a", "bb", "ccc", "dé", "日本", "e f"]
    passage = " ".join(rnd.choice(some) for _ in range(50))
    rows = [(i, " ".join(rnd.choice(some) for _ in range(rnd.randint(0, 40))) + (" " + passage if i % 4 == 0 else "") + "\n\tz") for i in range(30)]
    rows += [(40, None), (41, ""), (42, " \n "), (43, "w " * 80), (44, "L" * 2000), (45, "L" * 2000 + " a"), (None, passage), (4, rows[4][1]), (4, rows[4][1])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, block int")
    found = repeated_passages(docs, window=size, block_bytes=block, bucket_windows=bucket)
    assert _rows(found, "doc_id", "n_words", "n_removed", "kept") == _passages(rows, size)
    for r in found.collect():
        assert sum(e - s for s, e in zip(r.starts, r.ends, strict=True)) == r.n_removed
        assert all(e < s for e, s in zip(r.ends[:-1], r.starts[1:], strict=True))


def test_no_passages_without_rows(spark):
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_windows_are_equal_only_if_their_words_are():
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["a", "b", "ab", "ba"]) for _ in range(300)).encode() for _ in range(3)]
    block = Block(texts, 6)
    windows = [tuple(t.split()[s:s + 6]) for t in texts for s in range(295)]
    assert len(block.value) == len(set(windows))
    of = {}
    assert all(of.setdefault(w, i) == i for w, i in zip(windows, block.index, strict=True))


# ------------------------------------------------------------------ byte-level BPE


@pytest.mark.parametrize("chunk, overlap", [(40, 12), (17, 9), (64, 30), (1 << 15, 512)])
def test_chunks_encode_as_whole_texts(spark, chunk, overlap):
    rnd = random.Random(3)
    rows = [(0, None), (1, ""), (2, "a" * 300), (3, " " * 200 + "x"), (None, "\n\n  word's  \t x\r\n" * 30), (5, "<|endoftext|> x" * 9)]
    rows += [(10 + i, "".join(rnd.choice(["a", "bc", " ", "  ", "\n", "'s", "'re", "é", "日本", "12", "!!", "\x1c", "=", "word "]) for _ in range(rnd.randint(1, 300)))) for i in range(40)]
    rows += [rows[-1], rows[-1]]
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, sha string")
    tokenizer = encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    want = sorted(((d, len(ids := tokenizer.encode_ordinary(t or "")), np.array(ids, "<u4").tobytes(), (t or "").encode()) for d, t in rows), key=str)
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in encode_and_decode(docs, chunk=chunk, overlap=overlap).collect()]
    assert sorted(got, key=str) == want


def test_bpe_of_no_rows(spark):
    assert encode_and_decode(spark.createDataFrame([], "doc_id long, text string")).agg(F.count("*")).first()[0] == 0


# ------------------------------------------------------------------ stages keep names


def test_filters_take_any_column_names_and_tables(spark):
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (2, "a  b", None, 2), (3, None, "y", 3), (4, "", "z", 4), (None, "q", "w", 5), (None, "q", "w", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bad_id string, keep_id int").withColumnRenamed("bad_id", "bad.id").withColumn("bad_id", F.lit(1)).withColumn("_bad_hash", F.lit(2))
    items = spark.createDataFrame([(1, "q"), (1, "q"), (2, None), (None, "nothing here")], "item_id long, text string")
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.keep_id for r in left.collect()) == [1, 1, 2, 3, 4]
    assert drop_contaminated(docs, items.limit(0)).count() == 7 and drop_contaminated(docs.limit(0), items).count() == 0
    once = drop_exact_duplicates(docs)
    assert once.columns == docs.columns and sorted(r.keep_id for r in once.collect()) == [2, 3, 5, 5]
    assert drop_exact_duplicates(docs.limit(0)).count() == 0
