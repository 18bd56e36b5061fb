"""WARC archives: a record per page, each a gzip member of its own, and a sequential reader.

The writer folds equal payloads into revisit records that name the record with
the payload. The reader takes an archive as a stream: it inflates member after
member in pieces, frames each record by its Content-Length, and checks block
and payload digests. It holds one record at a time, and no index.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import new_folder, open_folder, partitions, text_batches, written

#: Equal payloads of fewer bytes are stored again each time.
REVISIT_BYTES = 1000
READ_BYTES = 256 * 1024
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "plumbline:page")


class WarcError(ValueError):
    """An archive that can't be read as written."""


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]

    @property
    def http(self) -> dict[str, str]:
        return _fields(self.block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:])

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page_id))}>"


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"not a header: {line[:80]!r}")
        out[name.strip().lower().decode()] = value.strip().decode()
    return out


def _safe(url: str) -> str:
    """A URL as a header can carry it: what would end the line is percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """A response with its payload, or a revisit without it, as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id) if page_id is not None else f'<urn:uuid:{uuid.uuid4()}>'}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += [f"WARC-Payload-Digest: {digest(payload)}", f"WARC-Block-Digest: {digest(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(whole) + pack.flush()


def _members(file: BinaryIO) -> Iterator[bytes]:
    """The gzip members of a stream, inflated piece by piece."""
    held, inflate, pieces = b"", None, []
    while True:
        data = held or file.read(READ_BYTES)
        held = b""
        if not data:
            break
        if inflate is None:
            inflate, pieces = zlib.decompressobj(31), []
        try:
            pieces.append(inflate.decompress(data))
        except zlib.error as e:
            raise WarcError(f"not gzip: {e}") from e
        if inflate.eof:
            yield b"".join(pieces)
            held, inflate = inflate.unused_data, None
    if inflate is not None:
        raise WarcError("the last member is cut short")


def read_records(file: BinaryIO) -> Iterator[Record]:
    """Records in order. Raises WarcError for a broken frame or digest."""
    for member in _members(file):
        head, gap, rest = member.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        if not gap or not lines[0].startswith(b"WARC/"):
            raise WarcError("a member doesn't begin with a record")
        headers = _fields(lines[1:])
        try:
            size = int(headers["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("no usable Content-Length") from e
        block, end = rest[:size], rest[size:]
        if len(block) != size or end != b"\r\n\r\n":
            raise WarcError("Content-Length doesn't frame the member")
        record = Record(headers, block)
        if "warc-block-digest" in headers and headers["warc-block-digest"] != digest(block):
            raise WarcError("block digest differs")
        if record.kind == "response" and "warc-payload-digest" in headers and headers["warc-payload-digest"] != digest(record.payload):
            raise WarcError("payload digest differs")
        yield record


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    store, root = open_folder(folder)
    name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
    file, records = None, 0
    for batch in batches:
        if batch.num_rows and file is None:
            store.create_dir(root, recursive=True)
            file = store.open_output_stream(f"{root}/{name}")
        for page_id, url, html, refers_to, revisit in zip(*(batch[c].to_pylist() for c in ("id", "url", "html", "refers_to", "revisit")), strict=True):
            file.write(page_record(page_id, url, html.encode(), refers_to, revisit))
            records += 1
    if file is not None:
        file.close()
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [records]})


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Writes an archive for each partition to the shared folder; returns their list (path, records).

    A null html is an empty payload. Of records with equal payloads of at least
    ``least`` bytes that with the largest id is the response, and all rows that
    repeat this id with it; the others revisit it, rows without id too, unless no
    row of the group has an id: then all are responses.
    """
    text_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    hashed = rows.withColumn("sha", F.unhex(F.sha2("html", 256)))
    large = F.octet_length("html") >= least
    # aggregated before the shuffle; what is joined back are payloads that occur more than once
    groups = hashed.where(large).groupBy("sha").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1 and largest is not null").select("sha", "largest")
    groups = written(groups, "op7-groups", narrow=True)
    revisit = F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest"))
    told = hashed.join(groups, (hashed["sha"] == groups["sha"]) & large, "left").select("id", "url", "html", F.when(revisit, F.col("largest")).alias("refers_to"), revisit.alias("revisit"))
    write = functools.partial(_write, folder=new_folder(pages.sparkSession, "op7-warc"))
    return pages.sparkSession.createDataFrame(told.mapInArrow(write, "path string, records long").collect(), "path string, records long")  # a row for each archive


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("html", pa.string())])
    for batch in batches:
        for path, records in zip(batch["path"].to_pylist(), batch["records"].to_pylist(), strict=True):
            store, root = open_folder(path)
            seen, out, held = 0, [], 0
            with store.open_input_stream(root) as file:
                for r in read_records(file):
                    own, other = (int(x) if (x := r.headers.get(k)) is not None else None for k in ("x-page-id", "x-refers-to-page-id"))
                    sha = base64.b32decode(r.headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                    response = r.kind == "response"
                    out.append((own, len(r.payload) if response else int(r.http["content-length"]), sha, r.kind, other, r.headers.get("warc-target-uri"), r.payload.decode() if response else None))
                    seen, held = seen + 1, held + len(r.block)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            if seen != records:
                raise WarcError(f"{path} has {seen} records; {records} were written")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest (hex), record_type, refers_to, url, html (null for revisits).

    Bytes and digest are those of the full payload, for revisits from their
    HTTP header and payload digest. Each archive is one task's stream.
    """
    n = partitions(archives.sparkSession)
    return archives.repartition(n).mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string")
