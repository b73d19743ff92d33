"""WARC archives of pages, and a normaliser for archives that were compressed as one stream."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.rows import ending, may_match
from sightline.plans.lineage import materialize
from sightline.plans.skew import join_counted

#: Uncompressed bytes after which a new archive begins; an archive exceeds it by one record at most.
ARCHIVE_BYTES = 8 << 20
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "array<struct<record_id:string,uri:string,type:string,offset:long,length:long>>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One response record, or a revisit record without the payload if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:unknown")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2020-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """archive, data: gzip archives of about ARCHIVE_BYTES, each compressed as one stream, one record per input row.

    The payload is the html in UTF-8, of a null html empty. Of equal payloads, that with the least id is the response
    and the others revisit it. Rows without an id are responses and never referred to, and of rows that repeat the least
    id each is a response. Payloads are compared by digest. Only ids and digests are shuffled to find the copies, and then
    the pages that may be revisits, as a map of bounded size tells: no html of any other page moves.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    seen = own.select("page_id", F.sha1("html").alias("digest")).where("page_id is not null")
    first = materialize(seen.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where("rows > 1"), "first")
    copies = join_counted(seen, first, "digest")  # error pages and empty ones may be most of all
    again = materialize(copies.where("page_id <> first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct(), "again")
    told = may_match(own.withColumn("digest", F.sha1("html")).withColumn("h", F.xxhash64("page_id", "digest")), again.withColumn("h", F.xxhash64("page_id", "digest")), "h", "copy")
    names = ["page_id", "url", "html"]
    dealt = told.where("not copy").select(*names, F.lit(None).cast("long").alias("refers_to")).unionByName(told.where("copy").join(again, ["page_id", "digest"], "left").select(*names, "refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, size, squeeze, held = TaskContext.get().partitionId(), 0, 0, None, []

        def close() -> pa.RecordBatch:
            nonlocal made, size, squeeze, held
            held.append(squeeze.flush())
            out = pa.RecordBatch.from_pydict({"archive": [f"part-{task:05d}-{made:05d}"], "data": pa.array([b"".join(held)], pa.binary())})
            made, size, squeeze, held = made + 1, 0, None, []
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, refers_to = (batch.column(k)[i].as_py() for k in range(4))
                record = page_record(page_id, url, html.encode(), refers_to, date)
                squeeze = squeeze or zlib.compressobj(level, zlib.DEFLATED, 31)
                held.append(squeeze.compress(record))
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield close()
        if squeeze:
            yield close()

    return dealt.mapInArrow(ending(write), "archive string, data binary")


def inflate(stream: BinaryIO) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, chunk by chunk; plain content passes, and zeros after a member.

    What isn't gzip after a member, or a member without its end, raises an error: no record is lost in silence.
    """
    raw = stream.read(CHUNK)
    if raw[:2] != b"\x1f\x8b":
        while raw:
            yield raw
            raw = stream.read(CHUNK)
        return
    member = zlib.decompressobj(31)
    while raw:
        yield member.decompress(raw, CHUNK)
        raw = member.unconsumed_tail
        if member.eof:
            raw = member.unused_data.lstrip(b"\0")
            while not raw and (raw := stream.read(CHUNK)):
                raw = raw.lstrip(b"\0")
            if not raw:
                return
            member = zlib.decompressobj(31)
        raw = raw or stream.read(CHUNK)
    raise ValueError("the archive ends within its compressed stream")


class _Reader:
    def __init__(self, chunks: Iterable[bytes]):
        self.chunks, self.held = iter(chunks), bytearray()

    def _more(self) -> bool:
        chunk = next(self.chunks, None)
        self.held += chunk or b""
        return chunk is not None

    def until(self, mark: bytes) -> bytes | None:
        at = self.held.find(mark)
        while at < 0:
            if not self._more():
                return None
            at = self.held.find(mark)
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def skip_line_ends(self) -> None:
        while (self.held or self._more()) and (not self.held or self.held[:1] in (b"\r", b"\n")):
            del self.held[:1]


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = (line.partition(":") for line in lines[1:] if ":" in line)
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in fields}


def records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields of the head, whole record with its end) of each record; an archive cut within a record raises an error."""
    reader = _Reader(chunks)
    while True:
        reader.skip_line_ends()
        head = reader.until(b"\r\n\r\n")
        if head is None:
            if reader.held:
                raise ValueError("the archive ends within a record's head")
            return
        fields = parse_head(head)
        yield fields, head + reader.take(int(fields["content-length"])) + b"\r\n\r\n"


def normalise(stream: BinaryIO, level: int = 6) -> Iterator[tuple[dict, bytes]]:
    """(index entry, gzip member) of each record: the input is inflated once, one record is held at a time."""
    offset = 0
    for fields, whole in records(inflate(stream)):
        member = gzip.compress(whole, level, mtime=0)
        yield {"record_id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "type": fields.get("warc-type"), "offset": offset, "length": len(member)}, member
        offset += len(member)


def normalise_archives(archives: DataFrame, name_col: str = "archive", data_col: str = "data", level: int = 6) -> DataFrame:
    """archive, data (a member for each record), index (offsets of the members). For files: spark.read "binaryFile".

    One row per input row. Null or empty data gives an archive without records, equal rows repeat, an empty table gives
    no rows; a broken archive raises an error. A task holds one archive and one record at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                entries, members = [], []
                for entry, member in normalise(io.BytesIO(batch.column(1)[i].as_py() or b""), level):
                    entries.append(entry)
                    members.append(member)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()], pa.string()), pa.array([b"".join(members)], pa.binary()), pa.array([entries], INDEX_ARROW)], names=["archive", "data", "index"])

    return archives.select(F.col(name_col).cast("string"), F.col(data_col)).mapInArrow(ending(run), f"archive string, data binary, index {INDEX}")


INDEX_ARROW = pa.list_(pa.struct([("record_id", pa.string()), ("uri", pa.string()), ("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))


def sidecar(normalised: DataFrame) -> DataFrame:
    """archive, record_id, uri, type, offset, length: the index as a table of its own, a row for each record."""
    return normalised.select("archive", F.explode("index").alias("i")).select("archive", "i.*")


def save(normalised: DataFrame, folder: str) -> DataFrame:
    """Write <archive>.warc.gz and its sidecar <archive>.index.jsonl to a folder that all executors mount.

    archive, records, bytes: a row for each archive written, once the frame is run. Files are written under another name
    and then renamed, so a task that runs again, after an executor is lost, leaves whole files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lines = "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in row["index"] or [])
                for end, body in ((".warc.gz", row["data"]), (".index.jsonl", lines.encode())):
                    path = os.path.join(folder, row["archive"] + end)
                    with open(own := f"{path}.{uuid.uuid4().hex}", "wb") as f:
                        f.write(body)
                    os.replace(own, path)
                yield pa.RecordBatch.from_pydict({"archive": [row["archive"]], "records": pa.array([len(row["index"] or [])], pa.int64()), "bytes": pa.array([len(row["data"])], pa.int64())})

    return normalised.select("archive", "data", "index").mapInArrow(run, "archive string, records long, bytes long")


def read_pages(normalised: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: each record is read at its offset alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, rows = memoryview(batch.column(0)[i].as_buffer()), []
                for entry in batch.column(1)[i].as_py() or []:
                    rows.append(page_row(gzip.decompress(data[entry["offset"] : entry["offset"] + entry["length"]])))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return normalised.select("data", "index").mapInArrow(ending(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def page_row(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """A response's length and digest are those of its payload; a revisit keeps both in its heads."""
    number = lambda s: int(m[1]) if s and (m := re.fullmatch(r"<urn:page:(-?\d+)>", s)) else None
    head, _, block = record.partition(b"\r\n\r\n")
    fields = parse_head(head)
    http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    if kind == "revisit":
        size, digest = int(parse_head(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    else:
        size, digest = len(payload), payload_digest(payload)
    return number(fields.get("warc-record-id")), size, digest, kind, number(fields.get("warc-refers-to"))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as one-stream archives, normalise these, read every record back by its offset.

    page_id, payload_bytes, payload_digest, record_type, refers_to; one row per input row. A null html is an empty
    payload; rows without an id are responses; equal rows repeat; an empty table gives no rows; payloads of any length
    are kept whole; other columns are not read.
    """
    archives = write_archives(pages, id_col, url_col, html_col)
    archives = materialize(archives, "archives")
    normalised = materialize(normalise_archives(archives), "warc")
    return read_pages(normalised)
