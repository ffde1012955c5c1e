"""Hard negatives against all scores in plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tellwise.llm import hard_negatives as n


def brute(rows):
    known = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        row = (label, list(vector))
        known[i] = min(known.get(i, row), row)
    rows = [(i, math.fmod(label + 1, 10) if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, (label, v) in known.items()]
    out = []
    for a, la, va in rows:
        if a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in rows if i != a]
        for below, p, label in sorted(x for x in scored if x[2] == la)[:5]:
            negatives = sorted(x for x in scored if x[2] != la and 30 * -below <= 100 * -x[0] <= 90 * -below)[:10]
            out += [(a, p, rank, i, -below, -s) for rank, (s, i, _) in enumerate(negatives, 1)]
    return sorted(out)


def got(spark, rows, element="float"):
    df = spark.createDataFrame([(i, v, label, "x", 0) for i, v, label in rows], f"vec_id long, embedding array<{element}>, label int, slot string, r int")
    found = n.hard_negatives(df)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def vectors(seed, size, width, labels):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(0.3, 0.25, (size, width)).astype(np.float32)
    return [(int(i * 4), [float(x) for x in base[i]], int(rnd.integers(0, labels))) for i in range(size)]


@pytest.mark.parametrize(("seed", "width", "labels"), [(1, 8, 2), (2, 3, 10), (3, 64, 4)])
def test_equals_brute_force_over_many_cells(spark, monkeypatch, seed, width, labels):
    monkeypatch.setattr(n, "ROW_BLOCK", 60)
    monkeypatch.setattr(n, "ANCHOR_BLOCK", 3)
    rows = vectors(seed, 300, width, labels)
    expected = brute(rows)
    assert len(expected) > 30
    assert got(spark, rows) == expected


def test_ties_repeats_nulls_and_odd_vectors(spark):
    rnd = random.Random(7)
    rows = [(i, [rnd.choice([0.0, 0.25, 0.5]) for _ in range(3)], rnd.randint(-1, 3)) for i in range(0, 700, 2)]
    rows += [(1, None, 1), (3, [0.1, None, 0.2], 1), (5, [0.1, float("nan"), 0.2], 1), (9, [float("inf"), 0.0, 0.0], 2), (None, [0.5] * 3, 1), (11, [0.5] * 3, None)]
    rows += [(200, [0.5, 0.5, 0.5], 1), (13, [], 1), (15, [0.5], 2), (17, [0.5] * 5, 1), (100, [], 2)] + [(19, [0.25] * 3, 1)] * 50 + [(19, [0.5] * 3, 0)] * 3
    rnd.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    rnd = random.Random(8)
    rows = [(i, [rnd.uniform(1e3, 3e4) for _ in range(4)], i % 3) for i in range(0, 500, 5)]
    expected = brute(rows)
    assert expected
    assert got(spark, rows, "double") == expected
    large = [(i, [rnd.uniform(1e5, 5e5) for _ in range(4)], i % 3) for i in range(0, 500, 5)]
    expected = brute(large)
    assert any(r[4] > 2 ** 54 for r in expected)
    assert got(spark, large, "double") == expected
    huge = [(i, [rnd.uniform(-1e308, 1e308) for _ in range(4)], i % 3) for i in range(0, 500, 5)]
    got(spark, huge, "double")


def test_scores_below_zero_open_no_window(spark):
    rows = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2), (3, [0.0], 2), (4, [0.5], 2)]
    assert got(spark, rows) == brute(rows) == []


def test_empty_table(spark):
    assert got(spark, []) == []
