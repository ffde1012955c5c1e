"""Manifests against trees built level by level in plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tellwise.llm import merkle as m


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        run = level[at // 16 * 16:at // 16 * 16 + 16]
        out.append((run[:at % 16], run[at % 16 + 1:]))
        at //= 16
    return out


def folded(leaf, path):
    for before, after in path:
        leaf = h(*before, leaf, *after)
    return leaf


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    root = top[-1][0]
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            path = siblings(trees[s], i) + siblings(top, k)
            other = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                other = leaf_of((*row[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])))
            end = folded(other, path)
            out.append((row[0], leaf, trees[s][-1][0], root, h(*(x for b, a in path for x in (*b, *a))), end, end == root))
    return sorted(out, key=str)


def got(spark, rows, extra="x int"):
    df = spark.createDataFrame([(*r, 1) for r in rows], f"doc_id long, source string, lang string, n_chars long, text string, {extra}")
    found = m.verified_leaves(m.document_manifest(df)).select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("leaves", [1, 2, 15, 16, 17, 33, 256, 257, 300, 4095, 4096])
def test_log_is_in_postorder_and_addressed_in_closed_form(leaves):
    nodes = [hashlib.sha256(str(i).encode()).digest() for i in range(leaves)]
    height = m.height_of(leaves, False)
    log, tree = m.append_log(nodes, height), levels([d.hex() for d in nodes])
    assert len(tree) == height + 1 and len(log) == 32 * m.nodes_of(leaves, height)
    for level, row in enumerate(tree):
        for i, digest in enumerate(row):
            at = m.position(level, i, leaves, height)
            assert log[32 * at:32 * at + 32].hex() == digest


def test_manifest_of_small_tables(spark):
    rnd = random.Random(4)
    for n in (1, 2, 17, 40):
        rows = [(i, rnd.choice([None, "", "a", "é", "b"]), None if i % 3 else "en", i, rnd.choice(["A", "Bc", "é", "", None, "x\ny"])) for i in range(n)]
        assert got(spark, rows) == brute(rows)


def test_manifest_of_uneven_sources(spark):
    rnd = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"s{rnd.randint(0, 300)}", "en", i, f"Text {i % 50}") for i in range(3000)]
    rows += [(7, "hot", "en", 7, "Same")] * 40 + [(None, None, None, None, None)] * 3 + [(None, "hot", None, 1, "X" * 200_000), (7, "hot", "de", 7, "Tie")]
    rnd.shuffle(rows)
    assert got(spark, rows, "digest int") == brute(rows)


def test_groups_over_several_blocks_and_tiers(spark, monkeypatch):
    rows = [(i, "a" if i % 4 else "b", "en", i, f"T{i}") for i in range(9000)]
    assert got(spark, rows) == brute(rows)


def test_paths_fold_to_the_root(spark):
    df = spark.createDataFrame([(i, f"s{i % 20}", None, i, "Ab") for i in range(500)], "doc_id long, source string, lang string, n_chars long, text string")
    manifest = m.document_manifest(df)
    for r in m.verified_leaves(manifest, paths=True).collect():
        path = [(p.before, p.after) for p in r.path]
        assert m.fold(r.leaf, path) == manifest.root
        assert hashlib.sha256("".join(b + a for b, a in path).encode()).hexdigest() == r.proof_sha256
        assert r.verified == (zlib.crc32(str(r.id).encode()) % 5 != 0)


def test_empty_table(spark):
    assert got(spark, []) == []
    assert m.document_manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).root is None
