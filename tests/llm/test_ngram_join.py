"""Similarity join against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tellwise.llm import ngram_join
from tellwise.llm.decontaminate import words
from tellwise.llm.ngram_join import _named, drop_similar, least_matches, similar_texts

hashed = F.xxhash64


def brute(rows):
    def known(text):
        return tuple(words(text)) or text or ""

    grams = {}
    for _, text in rows:
        tokens = known(text)
        grams[tokens] = {tokens[i:i + 5] for i in range(max(1, len(tokens) - 4))} if words(text) else set()
    root, links = {t: t for t in grams}, {t: set() for t in grams}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    every = list(grams)
    for i, a in enumerate(every):
        for b in every[i + 1:]:
            both = len(grams[a] & grams[b])
            if both and both >= 0.8 * (len(grams[a]) + len(grams[b]) - both):
                links[a].add(b)
                links[b].add(a)
                root[top(a)] = top(b)
    held = {}
    for d, text in rows:
        held.setdefault(known(text), []).append(d)
    classes = {}
    for t, ids in held.items():
        classes.setdefault(top(t), []).extend(ids)
    return sorted(((d, min((x for x in classes[top(t)] if x is not None), default=None), len(classes[top(t)]), len(held[t]) - 1, len(links[t]), sum(len(held[x]) for x in links[t]))
                   for d, text in rows for t in [known(text)]), key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randint(20, 200))] for _ in range(12)]
    out = []
    for i in range(160):
        text = list(base[0] if i % 2 else rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
        out.append((i, " ".join(text)))
    return out + [(200, None), (201, ""), (202, "!?"), (205, "--- +++"), (206, "!?"), (203, "One two"), (204, "one, TWO."), (None, out[3][1]), (3, out[3][1]), (None, "only nameless")]


@pytest.mark.parametrize("chunk", [400, 7])
def test_classes_and_links_match_brute_force(spark, rows, chunk):
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, id int")
    got = sorted((tuple(r[c] for c in ("doc_id", "class_id", "class_size", "n_copies", "n_links", "n_linked_rows")) for r in similar_texts(docs, chunk_texts=chunk).collect()), key=str)
    assert got == brute(rows)


def test_one_row_of_each_class_stays(spark, rows):
    docs = spark.createDataFrame(rows[:120], "doc_id long, text string")
    kept = sorted(r.doc_id for r in drop_similar(docs).collect())
    assert kept == sorted({r[1] for r in brute(rows[:120])})


def test_of_rows_without_ids_or_with_one_id_one_stays(spark):
    rows = [(1, "!!! ???", "a"), (2, "--- +++", "a"), (3, "--- +++", "b"), (4, "", "c"), (5, None, "c"), (None, "only nameless", "d"), (None, "only nameless", "d"), (None, "Only nameless!", "e"),
            (7, "two words", "f"), (7, "two words", "f"), (7, "Two words", "g"), (8, "two, words", "h"), (9, "clean", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    kept = drop_similar(docs)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert sorted((d for d, _, _ in got), key=str) == [1, 2, 4, 7, 9, None] and set(got) <= set(rows)
    assert drop_similar(docs.limit(0)).count() == 0


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    texts = spark.createDataFrame([(b"a",), (b"b",), (b"c",)], "words_hash binary")
    monkeypatch.setattr(ngram_join.F, "xxhash64", lambda *cols: F.lit(7).cast("long") if len(cols) == 1 else hashed(*cols))
    assert _named(texts).select("id").distinct().count() == 3


def test_no_rows(spark):
    assert similar_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pruning_bounds_rise_with_the_steps():
    bounds = least_matches()
    assert bounds == sorted(bounds) and 0 < bounds[-1] < 0.8 * 64
