"""Token store and archives: exact round trips."""

from __future__ import annotations

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tellwise.llm import archives as a
from tellwise.llm.token_store import Encoder, PerfectHash, _digests, documents_of, stored_documents, write_store
from tellwise.llm.warc import archived_pages, convert_arc, new_folder, read_warc, write_arc

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_pieces_encode_as_whole_texts(tokenizer):
    rnd = random.Random(6)
    encode = Encoder(PATH)
    encode.REMEMBERED, encode.CHARS, encode.ROW = 20, 200, 30
    signs = ["it", "'s", "'", " ", "  ", "\n", "é", "Ç", "12", "!", "...", "word", " ", " Zqx", " (w", " x-y", " éñ", " a'b", "''ll"]
    texts = ["".join(rnd.choice(signs + (["\t", "日", "²", "\u2003", "<|endoftext|>", "<|"] if i % 3 == 0 else [])) for _ in range(rnd.randint(0, 30))) for i in range(1500)]
    texts += ["", "a<|endoftext|> b", "x" * 5000, " " + "ab" * 3000 + " c"]
    for text, ids in zip(texts, encode(texts), strict=True):
        assert ids == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def test_store_keeps_ids_in_order(spark, tokenizer):
    rows = [(None, "a"), (3, "x\ty \n"), (3, "x"), (-5, None), (7, ""), (7, ""), (9, "<|endoftext|> a")] + [(i, f"some text {i}" * (i % 7)) for i in range(20, 120)]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, start int")
    got = [(r.start, r.n_tokens, r.ids_crc32, r.doc_id) for r in stored_documents(docs, shard_bytes=400, index_keys=20).collect()]
    counts = {}
    for d, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        counts.setdefault((len(ids), zlib.crc32(ids.tobytes()), d), []).append(1)
    assert sorted(((n, c, d) for _, n, c, d in got), key=str) == sorted((k for k, v in counts.items() for _ in v), key=str)
    got.sort()
    assert [g[3] for g in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for start, n, _, _ in got:
        assert start == at
        at += n


def test_keys_that_are_not_held_are_not_found(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(50)], "doc_id long, text string")
    store = write_store(docs)
    asked = spark.createDataFrame([(i,) for i in (1, 49, 50, 1000, None)], "doc_id long")
    assert sorted(r.doc_id for r in documents_of(store, asked).collect()) == [1, 49]
    assert stored_documents(docs.limit(0)).count() == 0


def test_perfect_hash_is_minimal():
    digests = _digests([f"key {i}" for i in range(5000)])
    perfect = PerfectHash.of(digests)
    assert sorted(perfect.slots(digests)) == list(range(5000))
    assert PerfectHash.of(digests[:0]).slots(digests[:3]).tolist() == [-1, -1, -1]


# ------------------------------------------------------------------ archives


@pytest.mark.parametrize("version", [1, 2])
def test_arc_header_lines(version):
    blocks = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>\n\n", b"", b"dns answer"]
    data = a.arc_version_block(version, "x.arc", "20240131") + b"".join(a.arc_record(version, f"http://h/{i} y", "20240131120000", "text/html", b) for i, b in enumerate(blocks))
    records = list(a.read_arc(io.BytesIO(data)))
    assert [r.block for r in records] == blocks and [r.is_http for r in records] == [True, False, False]
    assert records[0].payload == b"<p>\n\n" and records[0].fields["url"] == "http://h/0%20y"
    assert len({a.record_id("x", r, "d") for r in records}) == 3
    with pytest.raises(a.ArchiveError):
        list(a.read_arc(io.BytesIO(data[:-4])))
    headers, block = next(a.read_warc(io.BytesIO(a.warc_record("x", records[2]))))
    assert headers["warc-type"] == "resource" and headers["warc-date"] == "2024-01-31T12:00:00Z" and block == blocks[2]
    assert headers["warc-block-digest"] == headers["warc-payload-digest"] == f"sha1:{a.base32_sha1(block)}"


def test_old_addresses_with_blanks_and_short_dates():
    line = b"http://h/a b c 1.2.3.4 1999 text/html 2\nhi\n"
    record, = a.read_arc(io.BytesIO(a.arc_version_block(1, "n", "1999") + line))
    assert record.fields["url"] == "http://h/a b c" and a.warc_date(record.fields["date"]) == "1999-01-01T00:00:00Z"


@pytest.mark.parametrize("least", [0, 3])
def test_pages_come_back(spark, least):
    rows = [(9, "http://b/", "same"), (4, "http://c/ x\ny", "same"), (None, None, "same"), (5, "u", None), (6, "v", ""), (6, "v", ""), (7, "w", "é\r\n\r\n"), (2, "x", "é\r\n\r\n"), (10, "z", "ab"), (11, "z", "ab")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, bytes int")
    want, used = [], set()
    for page, _, html in rows:
        body = (html or "").encode()
        first = min((p for p, _, h in rows if (h or "").encode() == body and p is not None))
        response = len(body) < least or (page == first and body not in used)
        used |= {body} if page == first else set()
        want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else first))
    got = [tuple(r) for r in archived_pages(pages, least_revisit_bytes=least).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert archived_pages(pages.limit(0)).count() == 0


def test_files_are_dealt_over_tasks_and_responses_are_not_forced_to_the_driver(spark):
    pages = spark.range(400).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(cast(id % 90 as string), 50) as html").repartition(12)
    folder = new_folder(spark, "archives")
    arcs = write_arc(pages, folder)
    warcs = convert_arc(arcs, folder)
    assert arcs.count() == warcs.count() == 12
    read = read_warc(warcs, folder)
    assert read.rdd.getNumPartitions() == 12 and read.count() == 400
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        plan = archived_pages(pages)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Broadcast" not in plan and "MapInPandas" not in plan
