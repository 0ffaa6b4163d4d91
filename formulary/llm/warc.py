"""Legacy web archives: ARC files of both versions are read and rewritten as WARC records.

An archive is one row (name, content); each of its records is a gzip member of its own. ARC header lines
are read in the columns that the archive's version states, contents by their declared lengths. A record
whose payload another record holds too becomes a revisit of the one with the largest page id.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from formulary.llm.tables import stored

ARCHIVE_BYTES = 1 << 20  # uncompressed, about; a longer record has an archive of its own
ARCHIVE = "archive string, content binary"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

# Columns of a record's header line, by the version in the archive's first record.
ARC_COLUMNS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length"],
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
UNSAFE = re.compile(r"[\x00-\x20\x7f-\xa0]")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(content: bytes) -> Iterator[bytes]:
    """The uncompressed gzip members of an archive, one at a time."""
    left = memoryview(content)
    while len(left):
        unpacker = zlib.decompressobj(31)
        yield unpacker.decompress(left)
        left = left[len(left) - len(unpacker.unused_data) :]


# -- ARC -------------------------------------------------------------------------------------------


@dataclass
class ArcRecord:
    fields: dict[str, str]
    content: bytes


def arc_archive(name: str, version: int, records: Iterable[tuple[str, str, bytes]], date: str) -> bytes:
    """An ARC archive of (url, media type, content) records."""
    about = f"{version} 0 formulary\n{ARC_TITLES[version]}\n".encode()
    out = [_arc_line(version, f"filedesc://{name}", "text/plain", date, about, name)]
    out += [_arc_line(version, url, kind, date, content, name) for url, kind, content in records]
    return b"".join(map(_member, out))


def _arc_line(version: int, url: str, kind: str, date: str, content: bytes, name: str) -> bytes:
    url = UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"
    middle = ["200", base32_sha1(content), "-", "0", name] if version == 2 else []
    line = " ".join([url, "0.0.0.0", date, kind, *middle, str(len(content))])
    return line.encode("utf-8", "surrogatepass") + b"\n" + content + b"\n"


def read_arc(content: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC archive, its own description first. Raises ValueError where it is not one."""
    columns: list[str] | None = None
    for member in members(content):
        at = 0
        while at < len(member):
            if member[at : at + 1] in b"\r\n":  # records are set apart by empty lines
                at += 1
                continue
            end = member.find(b"\n", at)
            if end < 0:
                raise ValueError("header line without end")
            parts = member[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
            if columns is None:
                body = member[end + 1 :]
                version = int(body.split(b" ", 1)[0])
                if version not in ARC_COLUMNS or not parts[0].startswith("filedesc://"):
                    raise ValueError("not an ARC archive")
                columns = ARC_COLUMNS[version]
                names = ARC_COLUMNS[1] if len(parts) == 5 else columns
            else:
                names = columns
            if len(parts) != len(names):
                raise ValueError(f"{len(parts)} columns in a header line of {len(names)}")
            fields = dict(zip(names, parts))
            start, size = end + 1, int(fields["length"])
            if size < 0 or start + size > len(member):
                raise ValueError("record shorter than its declared length")
            yield ArcRecord(fields, member[start : start + size])
            at = start + size


# -- WARC ------------------------------------------------------------------------------------------


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head, with the empty line, and payload; without a head all is payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content[: end + 4], content[end + 4 :]) if end >= 0 else (content, b"")


def header_of(head: bytes, name: str) -> str | None:
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        if key.strip().lower() == name.lower():
            return value.strip()
    return None


def record_id(archive: str, place: int) -> str:
    """A name that depends on the record's place alone, so a recomputed archive repeats it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{place}')}>"


def _iso(date: str) -> str:
    return datetime.strptime(date.ljust(14, "0")[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def _warc(headers: list[tuple[str, str]], block: bytes) -> bytes:
    headers = [*headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return _member(head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n")


def warc_archive(archive: str, content: bytes, originals: dict[int, tuple[str, str]]) -> bytes:
    """The WARC archive of an ARC archive. `originals`: place of a revisit -> (record id, page id) it refers to."""
    out = []
    for place, record in enumerate(read_arc(content)):
        f = record.fields
        head, payload = split_http(record.content)
        named = [("WARC-Record-ID", record_id(archive, place)), ("WARC-Date", _iso(f["date"]))]
        if place == 0:
            about = f"software: formulary\r\nformat: WARC File Format 1.0\r\ndescription: from {f['url']}\r\n".encode()
            info = [("WARC-Type", "warcinfo"), *named, ("WARC-Filename", archive), ("Content-Type", "application/warc-fields")]
            out.append(_warc(info, about))
            continue
        block, kind = record.content, "response" if head else "resource"
        more = [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}")]
        if place in originals:
            kind, block = "revisit", head
            to, page = originals[place]
            more += [("WARC-Profile", PROFILE), ("WARC-Refers-To", to), ("WARC-Refers-To-Page", page)]
        more += [("WARC-Block-Digest", f"sha1:{base32_sha1(block)}")]
        media = "application/http; msgtype=response" if head else f["type"]
        out.append(
            _warc(
                [("WARC-Type", kind), *named, ("WARC-Target-URI", f["url"]), ("WARC-IP-Address", f["ip"]), *more]
                + [("Content-Type", media)],
                block,
            )
        )
    return b"".join(out)


def read_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record."""
    for member in members(content):
        end = member.index(b"\r\n\r\n") + 4
        lines = member[:end].decode("utf-8", "replace").split("\r\n")
        if lines[0] != "WARC/1.0":
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}
        yield fields, member[end : end + int(fields["content-length"])]


# -- tables ----------------------------------------------------------------------------------------


def arc_archives(pages: DataFrame, version: int = 1, date: str = "20240101000000") -> DataFrame:
    """(archive, content): the pages as ARC archives of about ARCHIVE_BYTES, packed within each task, no shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, bytes]] = []
        size = made = 0
        part = TaskContext.get().partitionId()

        def archive() -> pa.RecordBatch:
            name = f"pages-{part:06d}-{made:06d}.arc.gz"
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([arc_archive(name, version, held, date)], pa.binary())], ["archive", "content"]
            )

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html"))):
                body = (html.as_py() or "").encode("utf-8", "surrogatepass")
                number = "" if page_id.as_py() is None else page_id.as_py()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n"
                head += f"X-Page-Id: {number}\r\n\r\n"
                held.append((url.as_py() or "-", "text/html", head.encode() + body))
                size += len(body)
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    held, size, made = [], 0, made + 1
        if held:
            yield archive()

    return pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(pack, ARCHIVE)


HEADS = "archive string, place int, id string, page_id bigint, digest string, bytes bigint"


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, content in zip(batch.column("archive"), batch.column("content")):
            name, rows = archive.as_py(), []
            for place, record in enumerate(read_arc(content.as_py())):
                if place:
                    head, payload = split_http(record.content)
                    page = header_of(head, "X-Page-Id")
                    row = name, place, record_id(name, place), int(page) if page else None
                    rows.append((*row, base32_sha1(payload), len(payload)))
            types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, ["archive", "place", "id", "page_id", "digest", "bytes"])


def convert(archives: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(archive, content): the WARC archives of ARC archives.

    Of records with equal payloads of at least `min_bytes` bytes, the one with the largest page id (no id
    counts as least, ties by record id) keeps its payload, the others become revisits of it. `archives` is
    read twice, so hand in a stored table.
    """
    heads = archives.mapInArrow(_heads, HEADS).filter(F.col("bytes") >= min_bytes)
    rank = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "id")
    # Partial maxima leave each task once per payload, however many pages share it.
    originals = heads.groupBy("digest").agg(F.max(rank).alias("o"), F.count("*").alias("copies"))
    originals = originals.filter("copies > 1").select("digest", "o.page_id", "o.id")
    originals = originals.select("digest", F.col("page_id").alias("to_page"), F.col("id").alias("to_id"))
    revisits = heads.join(originals, "digest").filter("id != to_id")
    by_archive = revisits.groupBy("archive").agg(F.collect_list(F.struct("place", "to_id", "to_page")).alias("revisits"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content, listed in zip(*(batch.column(c) for c in ("archive", "content", "revisits"))):
                refers = {
                    r["place"]: (r["to_id"], "" if r["to_page"] is None else str(r["to_page"]))
                    for r in listed.as_py() or []
                }
                out = warc_archive(archive.as_py(), content.as_py(), refers)
                name = archive.as_py().replace(".arc", ".warc")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([out], pa.binary())], ["archive", "content"]
                )

    return archives.join(by_archive, "archive", "left").mapInArrow(rewrite, ARCHIVE)


RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def number(text: str | None) -> int | None:
        return int(text) if text else None

    for batch in batches:
        rows = []
        for content in batch.column("content"):
            for fields, block in read_warc(content.as_py()):
                if fields["warc-type"] not in ("response", "revisit"):
                    continue
                head, payload = split_http(block)
                size = int(header_of(head, "Content-Length"))
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and (len(payload), base32_sha1(payload)) != (size, digest):
                    raise ValueError(f"damaged record {fields['warc-record-id']}")
                page = number(header_of(head, "X-Page-Id"))
                rows.append((page, size, digest, fields["warc-type"], number(fields.get("warc-refers-to-page"))))
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def read_records(archives: DataFrame) -> DataFrame:
    """One row per response or revisit record of WARC archives; raises where a payload fails its digest."""
    return archives.mapInArrow(_records, RECORDS)


def archived_pages(pages: DataFrame, min_bytes: int = 0, version: int = 1) -> DataFrame:
    """pages -> ARC archives -> WARC archives -> their records: page_id, payload_bytes, payload_digest,
    record_type, refers_to.

    The payload is the html in UTF-8, null as empty; a null url is written as "-", a null page_id stays null
    and never is the original of a page with an id. Repeated rows are records of their own. Only page_id,
    url and html are read. Both kinds of archives are written in the shared folder when this is called.
    """
    arcs = stored(arc_archives(pages, version), "arc")
    return read_records(stored(convert(arcs, min_bytes), "warc"))
