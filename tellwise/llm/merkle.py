"""A manifest of a dataset as Merkle trees kept in postorder logs.

Each group's leaves make a tree of fan-out 16, and the groups' roots make one more. Trees are built by
aligned builders: a builder owns 4,096 consecutive nodes (16 ** 3), appends them to its log in the order
in which nodes are completed (children, then their parent: postorder) and is done with one node, which
is a leaf of the next tier. So no task holds more than 4,096 nodes, whatever the size of a group, and
builders run side by side.

In a postorder log nothing has to be searched. The subtree of node (level, i) begins after all the nodes
that x = i * 16 ** level leaves complete, which are x + x div 16 + x div 256 + ..., and ends with the node
itself; a subtree with m leaves has m + ceil(m / 16) + ... nodes. `position` is this sum, and siblings for
proofs are read at their positions.

A digest is lowercase hex of SHA-256 over its inputs, concatenated; digests enter as hex text. Logs hold
the 32 bytes of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellwise.llm.base import quoted, settled

FANOUT, HEIGHT = 16, 3
BLOCK = FANOUT ** HEIGHT
_HEX = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies left and right of a node in its run, as hex text, from its own level up to the root's.
_PATH = "array<struct<before:string,after:string>>"


def nodes_of(leaves: int, height: int) -> int:
    """Nodes of a subtree of that height."""
    return sum(-(-leaves // FANOUT ** level) for level in range(height + 1))


def position(level: int, index: int, leaves: int, height: int) -> int:
    """Place from 0 of node (level, index) in the postorder of a tree with so many leaves."""
    first = index * FANOUT ** level
    done = sum(first // FANOUT ** j for j in range(height + 1))
    return done + nodes_of(min(FANOUT ** level, leaves - first), level) - 1


def height_of(leaves: int, more: bool) -> int:
    """Levels above the leaves of a block: all of them where more blocks follow or precede it, else
    as many as leave one node."""
    if more:
        return HEIGHT
    height = 0
    while FANOUT ** height < leaves:
        height += 1
    return height


def append_log(leaves: list[bytes], height: int) -> bytes:
    """The digests of all nodes over the leaves, each appended when it is complete."""
    log: list[bytes] = []
    pending: list[list[str]] = [[] for _ in range(height + 1)]

    def add(level: int, digest: bytes) -> None:
        log.append(digest)
        pending[level].append(digest.hex())
        if level < height and len(pending[level]) == FANOUT:
            close(level)

    def close(level: int) -> None:
        run, pending[level] = pending[level], []
        add(level + 1, hashlib.sha256("".join(run).encode()).digest())

    for leaf in leaves:
        add(0, leaf)
    for level in range(height):
        if pending[level]:
            close(level)
    return b"".join(log)


def sibling_run(log: bytes, level: int, run: int, leaves: int, height: int) -> str:
    """The nodes of a run of one level as hex text, read at their positions."""
    count = -(-leaves // FANOUT ** level)
    at = [position(level, i, leaves, height) for i in range(run * FANOUT, min((run + 1) * FANOUT, count))]
    return "".join(log[32 * p:32 * p + 32].hex() for p in at)


def run_paths(log: bytes, leaves: int, height: int, above: list[tuple[str, str]]) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """For each run of leaves: its hex text, and the path (before, after) of its parent up to the root;
    above is the path of the log's last node. A tree of one node gives its text and no path of its own."""
    known: dict[tuple[int, int], str] = {}
    if height == 0:
        yield log.hex(), above
        return
    for run in range(-(-leaves // FANOUT)):
        path, index = [], run
        for level in range(1, height):
            at, index = _HEX * (index % FANOUT), index // FANOUT
            if (level, index) not in known:
                known[level, index] = sibling_run(log, level, index, leaves, height)
            path.append((known[level, index][:at], known[level, index][at + _HEX:]))
        yield sibling_run(log, 0, run, leaves, height), path + above


def beside(text: str, height: int, path: list[tuple[str, str]]) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """Each node of a run, as hex text, with its path."""
    for at in range(0, len(text), _HEX):
        yield text[at:at + _HEX], [(text[:at], text[at + _HEX:]), *path] if height else path


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in path:
        digest = hashlib.sha256(f"{before}{digest}{after}".encode()).hexdigest()
    return digest


def framed(value: Column) -> Column:
    """`-` for null, else the length in bytes, `:` and the value in UTF-8 (integers as decimals)."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


@dataclass(frozen=True)
class Manifest:
    """tiers: the logs, one table for each tier with a row for each builder: group, block (from 0),
    leaves, blocks (of its group), log; in the first tier also id and changed of its leaves. top: the
    same for the tree of groups. heads: group, subroot, index. root: hex text, None over no leaves."""

    tiers: list[DataFrame]
    top: list[DataFrame]
    heads: DataFrame
    root: str | None


def ranked(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows (kept in the shared folder already) with index, their number from 0 in their group by order.

    Rows are dealt by ranges of (group, order), so a group of any size is spread; what precedes a
    partition in its group is added from the sums by (partition, group). Rows that are equal in all
    of these are told apart by a number, as any of them may come first.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order]
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(partitions, *keys, "tie")
    part = settled(dealt.withColumn("part", F.spark_partition_id()))
    sums = part.groupBy("part", group).agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(F.col("part").alias("part_"), F.col(group).alias("group_"), F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part", group).orderBy(*order, "tie"))
    same = (F.col("part") == F.col("part_")) & (F.col(group) == F.col("group_"))
    found = part.withColumn("inside", inside).join(offsets, same)
    return found.withColumn("index", F.col("before") + F.col("inside") - 1).drop("tie", "part", "part_", "group_", "before", "inside")


def _built(nodes: DataFrame, extra: dict[str, pa.DataType]) -> DataFrame:
    """Logs of all blocks of nodes (group, index, count, digest and the columns of extra): a row for
    each block, with extra's columns as lists in the order of the leaves."""
    schema = "group string, block long, leaves int, blocks long, log binary" + "".join(f", {c} array<{'binary' if t == pa.binary() else 'long'}>" for c, t in extra.items())

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("index")
        blocks = -(-rows["count"][0].as_py() // BLOCK)
        log = append_log(rows["digest"].to_pylist(), height_of(len(rows), blocks > 1))
        lists = {c: pa.array([rows[c].to_pylist()], pa.list_(t)) for c, t in extra.items()}
        return pa.table({"group": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int64()),
                         "leaves": pa.array([len(rows)], pa.int32()), "blocks": pa.array([blocks], pa.int64()), "log": pa.array([log], pa.binary()), **lists})

    block = F.call_function("div", F.col("index"), F.lit(BLOCK).cast("long")).alias("block")
    dealt = nodes.select("group", block, "index", "count", "digest", *extra)
    return settled(dealt.groupBy("group", "block").applyInArrow(build, schema))


def _tree(nodes: DataFrame, extra: dict[str, pa.DataType]) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of all groups' trees, and (group, digest) of their roots."""
    last = F.substring("log", -32, 32).alias("digest")  # the last node of a log is its block's root
    tiers = [_built(nodes, extra)]
    roots = tiers[0].where("blocks = 1").select("group", last)
    while not (split := tiers[-1].where("blocks > 1")).isEmpty():
        tiers.append(_built(split.select("group", F.col("block").alias("index"), F.col("blocks").alias("count"), last), {}))
        roots = roots.union(tiers[-1].where("blocks = 1").select("group", last))
    return tiers, roots


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int, list[tuple[str, str]]]]:
    """Each row of blocks with its height and its root's path."""
    for batch in batches:
        for at in range(len(batch)):
            row = batch.slice(at, 1).to_pylist()[0]
            yield row, height_of(row["leaves"], row["blocks"] > 1), [(p["before"], p["after"]) for p in row["path"]]


def _node_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, index, path) of the nodes that the blocks' logs begin with."""
    pairs = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    for row, height, above in _blocks(batches):
        paths = [[{"before": b, "after": a} for b, a in path] for text, rest in run_paths(row["log"], row["leaves"], height, above) for _, path in beside(text, height, rest)]
        index = range(row["block"] * BLOCK, row["block"] * BLOCK + len(paths))
        yield pa.RecordBatch.from_pydict({"group": pa.array([row["group"]] * len(paths), pa.string()), "index": pa.array(index, pa.int64()), "path": pa.array(paths, pairs)})


def _with_paths(tiers: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """The blocks of the first tier with `path`, what lies beside the way from their roots up; above
    (group, path) has that of the groups' roots, which is nothing by default."""
    lifted = None
    for tier in reversed(tiers):
        found = tier.where("blocks = 1")
        found = found.withColumn("path", F.array().cast(_PATH)) if above is None else found.join(above, "group")
        if lifted is not None:
            known = lifted.withColumnRenamed("index", "block")
            found = found.unionByName(tier.where("blocks > 1").join(known, ["group", "block"]))
        lifted = found.select("group", "block", "leaves", "blocks", "log", "path").mapInArrow(_node_paths, f"group string, index long, path {_PATH}")
    return found


def leaf_digest(columns: list[Column]) -> Column:
    """Digest (binary) of the framed values of a row."""
    return F.unhex(F.sha2(F.concat(*map(framed, columns)), 256))


def build_manifest(leaves: DataFrame) -> Manifest:
    """The manifest of leaves: group (string, not null), id (long), digest (binary), and changed (binary:
    a digest to hold against the manifest later, or null). A group's leaves are in the order of id (nulls
    first), then digest; groups in bytewise order. Other columns are not read. No leaves give no root."""
    kept = settled(leaves.select("group", "id", "digest", "changed"))
    counts = kept.groupBy("group").agg(F.count("*").alias("count"))
    numbered = ranked(kept, "group", "id", "digest").join(counts, "group")
    tiers, roots = _tree(numbered, {"id": pa.int64(), "changed": pa.binary()})
    heads = settled(ranked(settled(roots.withColumn("all", F.lit(""))), "all", "group"))
    n = heads.count()
    top, whole = _tree(heads.select(F.col("all").alias("group"), "index", F.lit(n).cast("long").alias("count"), "digest"), {})
    root = whole.select(F.lower(F.hex("digest"))).first()
    return Manifest(tiers, top, heads.select("group", "index", F.lower(F.hex("digest")).alias("subroot")), root and root[0])


def verified_leaves(manifest: Manifest, paths: bool = False) -> DataFrame:
    """One row per leaf: group, index (from 0 in its group), id, leaf, subroot, root, proof_sha256 (digest
    of its siblings, level by level, left to right), folded_root (the root that `changed`, where it is
    set, or else the leaf gives with those siblings) and verified (is it the root?); with paths, also
    `path`, the siblings' hex text before and after it on each level. Digests are hex text."""
    root = manifest.root

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, height, above in _blocks(batches):
            out: dict[str, list] = {name: [] for name in ("leaf", "proof_sha256", "folded_root", "path")}
            at = 0
            for text, rest in run_paths(row["log"], row["leaves"], height, above):
                # Above the run itself all its leaves have one path; an unchanged leaf folds to the parent
                # by the run's own text, but is folded like the others, as a check of the log.
                tail = "".join(b + a for b, a in rest).encode()
                for leaf, path in beside(text, height, rest):
                    own = "".join(path[0]).encode() if height else b""
                    changed = row["changed"][at]
                    out["leaf"].append(leaf)
                    out["proof_sha256"].append(hashlib.sha256(own + tail).hexdigest())
                    out["folded_root"].append(fold(changed.hex() if changed is not None else leaf, path))
                    if paths:
                        out["path"].append([{"before": b, "after": a} for b, a in path])
                    at += 1
            n = len(out["leaf"])
            found = {"group": pa.array([row["group"]] * n, pa.string()), "index": pa.array(range(row["block"] * BLOCK, row["block"] * BLOCK + n), pa.int64()),
                     "id": pa.array(row["id"], pa.int64()), "subroot": pa.array([row["subroot"]] * n, pa.string()), **{c: pa.array(out[c], pa.string()) for c in ("leaf", "proof_sha256", "folded_root")}}
            if paths:
                found["path"] = pa.array(out["path"], pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))
            yield pa.RecordBatch.from_pydict(found)

    schema = "group string, index long, id long, subroot string, leaf string, proof_sha256 string, folded_root string" + f", path {_PATH}" * paths
    known = _with_paths(manifest.top).select("group", "block", "leaves", "blocks", "log", "path").mapInArrow(_node_paths, f"group string, index long, path {_PATH}").select("index", "path")
    above = settled(manifest.heads.join(known, "index").select("group", "subroot", "path"))
    blocks = _with_paths(manifest.tiers, above.select("group", "path")).join(above.select("group", "subroot"), "group")
    proved = blocks.mapInArrow(leaves, schema)
    return proved.withColumn("root", F.lit(root)).withColumn("verified", F.col("folded_root") == F.col("root"))


def document_manifest(docs: DataFrame, columns: list[str] | None = None, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text") -> Manifest:
    """The manifest of a table of documents, a tree for each source.

    A leaf is the digest of the columns' values. Null sources are a source of their own, before all
    others; a null id comes first in its source; equal ids follow each other by digest, and rows that
    repeat whole are leaves of their own. Beside each leaf whose id's CRC-32 (as decimal text) is
    divisible by 5, `changed` has the digest of the row with A-Z of the text in lower case; a null
    text stays null, a null id is never changed. Only digests move. Other columns are not read.
    """
    columns = columns or [id_col, group_col, "lang", "n_chars", text_col]
    altered = [F.translate(quoted(c), _UPPER, _LOWER) if c == text_col else quoted(c) for c in columns]
    tampered = F.crc32(quoted(id_col).cast("string").cast("binary")) % 5 == 0
    group = F.when(quoted(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), quoted(group_col).cast("string")))
    return build_manifest(docs.select(
        group.alias("group"), quoted(id_col).cast("long").alias("id"), leaf_digest([quoted(c) for c in columns]).alias("digest"),
        F.when(tampered, leaf_digest(altered)).alias("changed")))
