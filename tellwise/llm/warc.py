"""Pages to ARC archives, ARC archives to WARC, WARC back to rows: one file for each task. Rows that
only name a file are dealt out by number, as Spark would put them all into one task for their size.

Files get a name of their own for each attempt of a task, and the rows that name them come from the
attempt that counted; so a task that runs twice does no harm.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellwise.llm import archives as a
from tellwise.llm.base import as_uri, open_folder, settled, shared_folder

#: The date of archives that tell none.
NO_DATE = "19700101000000"
_LEVEL = 1


def _arc_writer(folder: str, version: int | None):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId()
        own = version or 1 + number % 2
        name, file_name = f"pages-{number:05}.arc.gz", f"pages-{number:05}-{uuid.uuid4().hex}.arc.gz"
        files, root = open_folder(folder)
        offset, records = 0, 0
        with files.open_output_stream(f"{root}/{file_name}", compression=None) as out:
            def put(data: bytes) -> None:
                nonlocal offset
                out.write(gzip.compress(data, _LEVEL, mtime=0))
                offset += len(data)

            put(a.arc_version_block(own, name, NO_DATE))
            for batch in batches:
                for page, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {page or ''}\r\nContent-Length: {len(html)}\r\n\r\n"
                    put(a.arc_record(own, url, NO_DATE, "text/html", head.encode() + html, name, offset))
                    records += 1
        yield pd.DataFrame({"file": [file_name], "archive": [name], "records": [records]})
    return write


def write_arc(pages: DataFrame, folder: str, version: int | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) as ARC files; one row for each file: file, archive (its
    name within), records. version None: 1 and 2 in turn. A null html is empty, a null url "-"."""
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    return settled(rows.mapInPandas(_arc_writer(folder, version), "file string, archive string, records long"))


def _arc_reader(folder: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = open_folder(folder)
        for batch in batches:
            for file, archive in zip(batch["file"], batch["archive"], strict=True):
                rows = []
                with files.open_input_file(f"{root}/{file}") as raw:
                    for record in a.read_arc(a.plain(raw)):
                        payload = record.payload
                        page = a.http_headers(record.http_header).get("x-page-id") if record.is_http else None
                        rows.append((file, archive, record.offset, page or None, len(payload), hashlib.sha256(payload).hexdigest(),
                                     a.record_id(archive, record, a.base32_sha1(payload)), record.fields["url"], record.fields["date"]))
                yield pd.DataFrame(rows, columns=["file", "archive", "offset", "page_id", "bytes", "sha256", "id", "url", "date"])
    return read


def _warc_writer(folder: str):
    def write(group: pd.DataFrame) -> pd.DataFrame:
        file, archive = group["file"].iloc[0], group["archive"].iloc[0]
        originals = {row.offset: a.Original(row.o_id, row.o_url, row.o_date) for row in group.itertuples() if row.o_id is not None}
        files, root = open_folder(folder)
        name = f"{archive.removesuffix('.gz').removesuffix('.arc')}-{uuid.uuid4().hex}.warc.gz"
        with files.open_input_file(f"{root}/{file}") as raw, files.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(gzip.compress(a.warcinfo(name), _LEVEL, mtime=0))
            for record in a.read_arc(a.plain(raw)):
                out.write(gzip.compress(a.warc_record(archive, record, originals.get(record.offset)), _LEVEL, mtime=0))
        return pd.DataFrame({"file": [name], "records": [len(group)]})
    return write


def _files(files: DataFrame) -> int:
    return max(1, files.count())


def convert_arc(arcs: DataFrame, folder: str, least_revisit_bytes: int = 0) -> DataFrame:
    """Converts ARC files (rows file, archive; in folder) to WARC files in folder; one row for each
    file: file, records.

    Of records with equal payloads the one with the smallest page id (numbers in order of value, no
    id last; then archive and offset) is a response, the others are revisits of it. Payloads of
    fewer than least_revisit_bytes are all responses.
    """
    schema = "file string, archive string, offset long, page_id string, bytes long, sha256 string, id string, url string, date string"
    n = _files(arcs)
    records = settled(arcs.select("file", "archive").repartition(n).mapInPandas(_arc_reader(folder), schema))
    number = F.col("page_id").try_cast("decimal(38,0)")
    rank = F.struct(F.col("page_id").isNull(), number, "page_id", "archive", "offset", F.col("id"), "url", "date")
    large = F.col("bytes") >= least_revisit_bytes
    first = (records.where(large).groupBy("sha256", "bytes").agg(F.min(rank).alias("r"))
             .select("sha256", "bytes", F.col("r.id").alias("o_id"), F.col("r.url").alias("o_url"), F.col("r.date").alias("o_date")))
    decided = records.join(first, ["sha256", "bytes"], "left")
    shown = [F.when(F.col("o_id") != F.col("id"), F.col(c)).alias(c) for c in ("o_id", "o_url", "o_date")]
    return settled(decided.select("file", "archive", "offset", *shown).repartitionByRange(n, "file").groupBy("file")
                   .applyInPandas(_warc_writer(folder), "file string, records long"))


def _warc_reader(folder: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = open_folder(folder)
        for batch in batches:
            for file in batch["file"]:
                rows = []
                with files.open_input_file(f"{root}/{file}") as raw:
                    for head, block in a.read_warc(a.plain(raw)):
                        if head["warc-type"] not in ("response", "revisit", "resource"):
                            continue
                        http = a.http_headers(block) if head["content-type"].startswith("application/http") else {}
                        length = int(http.get("content-length") or len(block))
                        rows.append((http.get("x-page-id") or None, head["warc-type"], head["warc-record-id"].strip("<>"), head["warc-target-uri"], head["warc-date"],
                                     length, head["warc-payload-digest"].removeprefix("sha1:"), head.get("warc-refers-to", "").strip("<>") or None))
                yield pd.DataFrame(rows, columns=["page_id", "type", "id", "url", "date", "payload_bytes", "payload_digest", "refers_to_id"])
    return read


def read_warc(warcs: DataFrame, folder: str) -> DataFrame:
    """One row for each response, revisit or resource record of the files (rows file; in folder):
    page_id, type, id, url, date, payload_bytes, payload_digest, refers_to_id."""
    schema = "page_id string, type string, id string, url string, date string, payload_bytes long, payload_digest string, refers_to_id string"
    return warcs.select("file").repartition(_files(warcs)).mapInPandas(_warc_reader(folder), schema)


def new_folder(spark: SparkSession, kind: str) -> str:
    folder = f"{as_uri(shared_folder(spark))}/{kind}-{uuid.uuid4().hex}"
    files, root = open_folder(folder)
    files.create_dir(root, recursive=True)
    return folder


def archived_pages(pages: DataFrame, folder: str | None = None, version: int | None = None, least_revisit_bytes: int = 0) -> DataFrame:
    """One row per row of pages (page_id, url, html), from WARC files converted from ARC files:
    page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response).

    A null html is empty, a null url becomes "-", a null page_id stays null. Rows that repeat are
    records of their own; one of them is the response. Blanks and control characters of addresses
    are percent-encoded in the archives. Other columns are not read; an empty table gives no rows.
    """
    folder = folder or new_folder(pages.sparkSession, "archives")
    warcs = convert_arc(write_arc(pages, folder, version), folder, least_revisit_bytes)
    records = settled(read_warc(warcs, folder))
    kind = pages.schema["page_id"].dataType
    response = records.where("type = 'response'").select(F.col("id").alias("refers_to_id"), F.col("page_id").cast(kind).alias("refers_to"))
    return records.join(response, "refers_to_id", "left").select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
