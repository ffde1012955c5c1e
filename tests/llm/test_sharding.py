"""Sharding against a plain Feistel network, and the law of the shards."""

from __future__ import annotations

import random
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tellwise.llm import sharding as s


def spark_hash(*longs):
    """xxhash64 of (int, long, long), as Spark chains it."""
    turn, digit, seed = longs
    h = 42
    for fmt, v in (("<i", turn), ("<q", digit), ("<q", seed)):
        h = xxhash.xxh64_intdigest(struct.pack(fmt, v), seed=h)
    return h - (1 << 64) if h >> 63 else h


def plain(x, n, seed):
    a, b = s._radix(n)
    while True:
        low, high = x % a, x // a
        for t in range(s.ROUNDS):
            if t % 2 == 0:
                low = (low + (spark_hash(t, high, seed) >> 2)) % a
            else:
                high = (high + (spark_hash(t, low, seed) >> 2)) % b
        x = high * a + low
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000, 1023])
def test_permutation_and_its_inverse(spark, n):
    x = F.col("id")
    rows = spark.range(n).select(x, s.permuted(x, n, 9).alias("y"), s.restored(s.permuted(x, n, 9), n, 9).alias("z")).collect()
    assert sorted(r.y for r in rows) == list(range(n))
    assert all(r.z == r.id and r.y == plain(r.id, n, 9) for r in rows)


def test_permutation_of_large_numbers(spark):
    n = (1 << 40) + 12345
    x = F.col("id") * 1_000_003_111
    rows = spark.range(1000).select(x.alias("x"), s.permuted(x, n).alias("y"), s.restored(s.permuted(x, n), n).alias("z")).collect()
    assert all(r.y == plain(r.x, n, s.SEED) and r.z == r.x for r in rows)


def check_places(rows, docs, shards):
    expected = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert sorted(r.number for r in rows) == list(range(len(docs)))


def documents(spark):
    rnd = random.Random(3)
    docs = [(i, "".join(rnd.choice("abé日 \n") for _ in range(rnd.randint(0, 40))), None if i % 3 else "x") for i in range(700)]
    docs += [(7, "same", "x")] * 3000 + [(None, None, None)] * 5 + [(None, "", None), (1, None, "q"), (900, "w" * 300_000, None), (901, "tie", None), (902, "tie", None)]
    rnd.shuffle(docs)
    return docs, spark.createDataFrame(docs, "doc_id long, text string, shard string")


def test_places_follow_from_the_rows_alone(spark):
    docs, df = documents(spark)
    first = s.shard_places(df, shards=16).collect()
    check_places(first, docs, 16)
    again = s.shard_places(df.repartition(7, "text").select("doc_id", "text", "shard"), shards=16).collect()
    assert Counter(first) == Counter(again)
    assert Counter(s.shard_places(df, shards=16, seed=5).collect()) != Counter(first)


def test_small_buckets_and_runs_give_gapless_numbers(spark, monkeypatch):
    monkeypatch.setattr(s, "RUN", 16)
    monkeypatch.setattr(s, "BUCKET_ROWS", 8)
    monkeypatch.setattr(s, "BUCKETS", 4)
    docs, df = documents(spark)
    check_places(s.shard_places(df, shards=5).collect(), docs, 5)


def test_row_at_finds_the_number_of_a_place(spark):
    docs, df = documents(spark)
    at = s.row_at(F.col("shard"), F.col("slot"), len(docs), shards=16)
    assert all(r.number == r.at for r in s.shard_places(df, shards=16).withColumn("at", at).collect())


def test_shards_hold_whole_rows(spark, tmp_path):
    docs, df = documents(spark)
    s.write_shards(df, str(tmp_path / "out"), shards=4, slots_per_file=100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(tuple(r.row) for r in back.collect()) == Counter(docs)
    places = Counter((r.doc_id, r.shard, r.slot) for r in s.shard_places(df, shards=4).collect())
    assert Counter((r.row.doc_id, r.shard, r.slot) for r in back.collect()) == places
    for file in {f[0] for f in back.select(F.input_file_name()).collect()}:
        slots = [r.slot for r in spark.read.parquet(file).collect()]
        assert slots == sorted(slots)


def test_empty_table_and_odd_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, slot int")
    assert s.shard_places(empty).collect() == []
    assert s.sharded(empty).collect() == []
    odd = spark.createDataFrame([(1, "a", {"k": 1}, 2.0, [1])], "doc_id long, text string, number map<string,int>, `d1.x` double, row array<int>")
    assert s.shard_places(odd).count() == 1
    row = s.sharded(odd).first().row
    assert row["number"] == {"k": 1} and row["row"] == [1]
