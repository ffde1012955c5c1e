"""Shards by a permutation of row numbers, with DataFrame operations only.

Every row gets a global row number from its content, so that neither the files nor the partitions of
the input matter: rows that repeat whole are first combined to (digest, copies), these are cut into
runs of at most RUN copies, runs are dealt into buckets by hash, and a run's first number is the sum
of the buckets before its own and of the runs before it in its bucket.

A Feistel network permutes the numbers 0 to n - 1. A number is two digits in the mixed radix (a, b)
with a * b just above n; each round adds a hash of one digit to the other, modulo its radix, which can
be undone. Numbers that land at n or beyond walk on through the network until they are below n. A
walk passes at most the a * b - n numbers out of range, so it ends. The place follows from the
permuted number alone: shard = number mod shards, slot = number div shards; `row_at` computes the row
number from a place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tellwise.llm.base import quoted, settled, text_or_empty

SHARDS = 16
SEED = 20_240_131
ROUNDS = 8
#: Copies of a row that are numbered as one run; rows to a bucket, and buckets to a sum of buckets.
RUN, BUCKET_ROWS, BUCKETS = 1024, 2048, 4096
#: Walks are longer with a chance below n ** -(WALK / 2); those raise an error.
WALK = 48


def _radix(n: int) -> tuple[int, int]:
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _network(x: Column, n: int, seed: int, back: bool) -> Column:
    """One pass of x (0 to a * b - 1) through the network, or back through it."""
    a, b = _radix(n)

    def drawn(turn: Column, digit: Column) -> Column:
        hashed = F.xxhash64(turn, digit, F.lit(seed).cast("long"))
        return F.negative(F.shiftright(hashed, 2)) if back else F.shiftright(hashed, 2)

    def turned(digits: Column, turn: Column) -> Column:
        low, high = digits["low"], digits["high"]
        return F.when(turn % 2 == 0, F.struct(F.pmod(low + drawn(turn, high) % a, F.lit(a).cast("long")).alias("low"), high.alias("high"))).otherwise(
            F.struct(low.alias("low"), F.pmod(high + drawn(turn, low) % b, F.lit(b).cast("long")).alias("high")))

    turns = F.array(*(F.lit(t) for t in (reversed(range(ROUNDS)) if back else range(ROUNDS))))
    start = F.struct((x % a).alias("low"), F.call_function("div", x, F.lit(a).cast("long")).alias("high"))
    return F.aggregate(turns, start, turned, lambda digits: digits["high"] * a + digits["low"])


def _walked(x: Column, n: int, seed: int, back: bool) -> Column:
    a, b = _radix(n)
    steps = F.sequence(F.lit(0), F.lit(min(a * b - n, WALK - 1)))
    found = F.aggregate(steps, x, lambda y, k: F.when((k > 0) & (y < n), y).otherwise(_network(y, n, seed, back)))
    return F.when(found < n, found).otherwise(F.raise_error("the walk did not end; take another seed").cast("long"))


def permuted(number: Column, n: int, seed: int = SEED) -> Column:
    """The permutation of 0 to n - 1 (long)."""
    return _walked(number.cast("long"), n, seed, back=False)


def restored(number: Column, n: int, seed: int = SEED) -> Column:
    """The inverse of `permuted`."""
    return _walked(number.cast("long"), n, seed, back=True)


def row_at(shard: Column, slot: Column, n: int, shards: int = SHARDS, seed: int = SEED) -> Column:
    """The number of the row at a place."""
    return restored(slot.cast("long") * shards + shard, n, seed)


def _digests(df: DataFrame) -> list[Column]:
    """Two hashes of a whole row. Nulls are marked, as a hash skips them."""
    def hashable(field: T.StructField) -> Column:
        kind = field.dataType.simpleString()
        return F.to_json(F.struct(quoted(field.name).alias("v"))) if "map<" in kind or "variant" in kind else quoted(field.name)

    parts = [part for field in df.schema for part in (quoted(field.name).isNull(), hashable(field))]
    return [F.xxhash64(*parts).alias("d1"), F.xxhash64(F.lit(1), *parts).alias("d2")]


def _runs(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(d1, d2, doc_id, size, text_crc32, length, start) of runs of equal rows, and the number of
    rows: the run's rows have the numbers from start on."""
    text = F.encode(text_or_empty(quoted(text_col)), "UTF-8")
    rows = docs.select(*_digests(docs), quoted(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    firsts = [F.any_value(c).alias(c) for c in ("doc_id", "size", "text_crc32")]
    classes = settled(rows.groupBy("d1", "d2").agg(*firsts, F.count("*").alias("copies")))
    n = classes.agg(F.sum("copies")).first()[0] or 0
    cut = classes.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long"))))
    cut = (cut.withColumn("length", F.least(F.lit(RUN).cast("long"), F.col("copies") - F.col("first")))
           .withColumn("bucket", F.pmod(F.xxhash64("d1", "d2", "first"), F.lit(n // BUCKET_ROWS + 1).cast("long"))))
    ordered = Window.partitionBy("bucket").orderBy("d1", "d2", "first").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("inside", F.coalesce(F.sum("length").over(ordered), F.lit(0)))
    # The sum of the buckets before: within a group of buckets, and of the groups before.
    sums = cut.groupBy("bucket").agg(F.sum("length").alias("rows")).withColumn("group", F.call_function("div", F.col("bucket"), F.lit(BUCKETS).cast("long")))
    groups = sums.groupBy("group").agg(F.sum("rows").alias("rows"))
    before = groups.select("group", F.coalesce(F.sum("rows").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("rows").over(Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("within", within).join(before, "group").select("bucket", (F.col("before") + F.col("within")).alias("offset"))
    found = placed.join(offsets, "bucket").withColumn("start", F.col("offset") + F.col("inside"))
    return found.select("d1", "d2", "doc_id", "size", "text_crc32", "length", "start"), n


def _spread(runs: DataFrame, n: int, shards: int, seed: int) -> DataFrame:
    """A row for each number of a run, with number, shard and slot."""
    numbered = runs.withColumn("number", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)))
    at = permuted(F.col("number"), max(n, 1), seed)
    return (numbered.withColumn("at", at).withColumn("shard", (F.col("at") % shards).cast("int"))
            .withColumn("slot", F.call_function("div", F.col("at"), F.lit(shards).cast("long"))))


def shard_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, size (bytes of the text in UTF-8 plus 1), text_crc32, number,
    shard, slot. Shards differ by one row at most; a shard's slots are 0, 1, 2 and so on.

    The same rows, seed and number of shards give the same places, however the rows are dealt over
    files and partitions. Only digests and sizes move, never texts. A null text counts as empty, a null
    id is an id like others. Rows that repeat whole get different places. All columns count for the
    order, whatever their names; an empty table gives no rows.
    """
    runs, n = _runs(docs, id_col, text_col)
    return _spread(runs, n, shards, seed).select("doc_id", "size", "text_crc32", "number", "shard", "slot")


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: shard, slot, and `row`, a struct of all its columns (so that their names
    can't clash). Of rows that repeat whole, one moves; it is spread over its places run by run."""
    runs, n = _runs(docs, id_col, text_col)
    whole = F.struct(*(quoted(c) for c in docs.columns)).alias("row")
    rows = docs.select(*_digests(docs), whole).groupBy("d1", "d2").agg(F.any_value("row").alias("row"))
    joined = rows.join(runs.select("d1", "d2", "length", "start"), ["d1", "d2"])
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _spread(joined.repartition(partitions, "start"), n, shards, seed).select("shard", "slot", "row")


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, slots_per_file: int = 1 << 20) -> None:
    """docs as Parquet in folder/shard=N, the rows of a file in the order of their slots. A shard is cut
    into files of slots_per_file slots, so that no task holds a whole shard."""
    part = F.call_function("div", F.col("slot"), F.lit(slots_per_file).cast("long"))
    placed = sharded(docs, id_col, text_col, shards, seed)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed.repartition(partitions, "shard", part).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
