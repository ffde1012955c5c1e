"""ARC archives of versions 1 and 2, converted to WARC.

An ARC file begins with a version block that names the version and the fields of the header lines.
Each record is one header line (5 fields in version 1, 10 in version 2), then as many bytes as the
line's last field declares, then a line feed. The converter gives every record what WARC wants and
ARC lacks: an identifier (a name-based UUID of archive, offset, address, date and digest, so a
second conversion gives the same), an ISO timestamp, a type, and digests of block and payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

ARC_FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result", "checksum", "location", "offset", "filename", "length"),
}
_FIELD_NAMES = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_IDENTITY = uuid.uuid5(uuid.NAMESPACE_URL, "arc-to-warc")


class ArchiveError(ValueError):
    """The file isn't a well-formed archive."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


# ------------------------------------------------------------------ ARC


@dataclass(frozen=True)
class ArcRecord:
    offset: int
    fields: dict[str, str]
    block: bytes

    @property
    def is_http(self) -> bool:
        return self.block.startswith(b"HTTP/")

    @property
    def http_header(self) -> bytes:
        return self.block[:len(self.block) - len(self.payload)] if self.is_http else b""

    @property
    def payload(self) -> bytes:
        if not self.is_http:
            return self.block
        head, blank, body = self.block.partition(b"\r\n\r\n")
        return body if blank else b""


def _token(value: str) -> str:
    """A header field: no blanks and no control characters, never empty."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value) or "-"


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = b"%d 0 tellwise\n%s\n" % (version, _FIELD_NAMES[version])
    extra = f" 200 - - 0 {_token(name)}" if version == 2 else ""
    return f"filedesc://{_token(name)} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, content_type: str, block: bytes, name: str = "-", offset: int = 0, ip: str = "0.0.0.0") -> bytes:
    extra = f" 200 {base32_sha1(block)} - {offset} {_token(name)}" if version == 2 else ""
    return f"{_token(url)} {ip} {date} {content_type}{extra} {len(block)}\n".encode() + block + b"\n"


def plain(file: BinaryIO) -> BinaryIO:
    """The file, decompressed if it is gzip."""
    buffered = io.BufferedReader(file, 1 << 20) if isinstance(file, io.RawIOBase) else file
    start = buffered.read(2)
    buffered.seek(0)
    return gzip.GzipFile(fileobj=buffered) if start == b"\x1f\x8b" else buffered


def _exactly(file: BinaryIO, n: int, where: str) -> bytes:
    data = file.read(n)
    if len(data) != n:
        raise ArchiveError(f"{where}: {n} bytes declared, {len(data)} there")
    return data


def read_arc(file: BinaryIO) -> Iterator[ArcRecord]:
    """Records of an ARC file without its version block. Addresses may hold blanks: fields are
    counted from the end of the line."""
    offset, version = 0, 0
    while line := file.readline():
        at, offset = offset, offset + len(line)
        if not line.strip():
            continue
        if not version:
            if not line.startswith(b"filedesc://"):
                raise ArchiveError(f"offset {at}: no version block")
            block = _exactly(file, int(line.rsplit(b" ", 1)[1]), f"offset {at}")
            version = int(block.split(None, 1)[0])
            if version not in ARC_FIELDS:
                raise ArchiveError(f"offset {at}: version {version}")
            offset += len(block)
            continue
        names = ARC_FIELDS[version]
        values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            raise ArchiveError(f"offset {at}: not a header line of version {version}")
        block = _exactly(file, int(values[-1]), f"offset {at}")
        offset += len(block)
        yield ArcRecord(at, dict(zip(names, values, strict=True)), block)


# ------------------------------------------------------------------ WARC


def warc_date(date: str) -> str:
    """An ISO timestamp of an ARC date of 4 to 14 digits; missing parts are the earliest."""
    digits = (re.sub(r"\D", "", date) + "00000101000000"[len(re.sub(r"\D", "", date)):])[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"


def record_id(archive: str, record: ArcRecord, digest: str) -> str:
    fields = record.fields
    return uuid.uuid5(_IDENTITY, f"{archive} {record.offset} {fields['url']} {fields['date']} {digest}").urn


@dataclass(frozen=True)
class Original:
    """The response that a revisit refers to."""

    id: str
    url: str
    date: str


def warc_record(archive: str, record: ArcRecord, original: Original | None = None) -> bytes:
    """The record in WARC 1.1: a revisit of original, a response if it is HTTP, else a resource."""
    digest = base32_sha1(record.payload)
    block = record.http_header if original else record.block
    kind = "revisit" if original else "response" if record.is_http else "resource"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id(archive, record, digest)}>",
        f"WARC-Date: {warc_date(record.fields['date'])}", f"WARC-Target-URI: {record.fields['url']}",
        f"WARC-IP-Address: {record.fields['ip']}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if original:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <{original.id}>", f"WARC-Refers-To-Target-URI: {original.url}", f"WARC-Refers-To-Date: {warc_date(original.date)}"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if record.is_http else record.fields['content_type']}",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warcinfo(name: str) -> bytes:
    block = b"software: tellwise\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <{uuid.uuid5(_IDENTITY, name).urn}>", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Filename: {_token(name)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_warc(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ArchiveError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, _exactly(file, int(headers["content-length"]), headers.get("warc-record-id", "record"))


def http_headers(block: bytes) -> dict[str, str]:
    head = block.partition(b"\r\n\r\n")[0].decode("latin-1").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in head)}
