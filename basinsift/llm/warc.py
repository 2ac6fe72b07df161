"""WARC archives: a Python data source that reads and writes them, and de-duplicated writing of pages.

Reading plans one partition for each share of files.  Record-type and header predicates are pushed down;
a record's headers are parsed first, and its payload is neither decompressed nor decoded if the record is
not wanted or the payload was not asked for (option ``payload=false``).  Compressed records written here
carry their own length in the gzip extra field ``sl``, so that a reader jumps over the rest of a record;
archives without it are read through.  Writing rolls files at ``max_file_bytes``; files appear under their
final name only when the whole job commits.

Defined results: null html counts as empty; a null url is left out; line breaks in header values are
percent-encoded; a page without id is always a response; rows that repeat the largest id of equal payloads
are all responses; an empty table writes and reads an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, WriterCommitMessage

from basinsift.llm.common import materialize, scratch, small_batches, table

SCHEMA = "page_id long, record_type string, target_uri string, record_id string, payload_digest string, refers_to long, payload_bytes long, payload binary"
#: Header behind each column that can be tested before the payload is touched.
HEADERS = {"record_type": "warc-type", "target_uri": "warc-target-uri", "record_id": "warc-record-id", "payload_digest": "warc-payload-digest"}
PARTITION_BYTES = 64 << 20
MAX_FILE_BYTES = 256 << 20
#: Duplicated payload digests that may be broadcast to the writers.
MAX_BROADCAST_DIGESTS = 100_000
_URN = "urn:basinsift:page:"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (pafs.LocalFileSystem(), path)


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit (``refers_to``) keeps the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_URN}{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<{_URN}{refers_to}>"), ("WARC-Profile", _REVISIT)]
    headers += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member with its compressed and plain lengths in the extra field ``sl``."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF if total < 1 << 32 else 0, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Source:
    """Plain bytes of one record at a time from a file that is gzip-compressed by record, or not at all."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.at, self.size = file, 0, file.size()

    def begin(self) -> bool:
        """Moves to the record at the present offset; False at the end."""
        if self.at >= self.size:
            return False
        self.file.seek(self.at)
        self.raw = self.file.read(min(4096, self.size - self.at))
        self.read_to = self.at + len(self.raw)
        self.plain, self.used, self.length = bytearray(), 0, 0
        self.inflate = None
        if self.raw[:3] == b"\x1f\x8b\x08":
            self.inflate = zlib.decompressobj(31)
            if self.raw[3] & 4 and self.raw[12:14] == b"sl":
                self.length = struct.unpack("<I", self.raw[16:20])[0]
        return True

    def need(self, count: int) -> bool:
        """Makes at least ``count`` plain bytes of the record available, unless it ends before."""
        while len(self.plain) < count:
            if self.inflate is None:
                more = self.raw or self.file.read(_CHUNK)
                self.raw = b""
                if not more:
                    return False
                self.plain += more
            else:
                if self.inflate.eof:
                    return False
                data = self.inflate.unconsumed_tail or self.raw or self.file.read(_CHUNK)
                if not self.inflate.unconsumed_tail and not self.raw:
                    self.read_to += len(data)
                if not self.inflate.unconsumed_tail:
                    self.raw = b""
                if not data:
                    return False
                self.plain += self.inflate.decompress(data, max(1, count - len(self.plain)))
        return True

    def find(self, mark: bytes, start: int = 0, end: int | None = None) -> int:
        """Offset behind the next ``mark`` that lies before ``end``, or -1."""
        while (found := self.plain.find(mark, start, end)) < 0:
            if end is not None and len(self.plain) >= end:
                return -1
            start = max(start, len(self.plain) - len(mark))
            if not self.need(len(self.plain) + 1024) and self.plain.find(mark, start, end) < 0:
                return -1
        return found + len(mark)

    def skip(self, plain_length: int) -> None:
        """Ends the record: jumps if its compressed length is known or it is not compressed, else reads through."""
        if self.inflate is None:
            self.at += plain_length
        elif self.length:
            self.at += self.length
        else:
            while not self.inflate.eof and self.need(len(self.plain) + _CHUNK):
                del self.plain[:]
            self.at = self.read_to - len(self.inflate.unused_data)


def text_of(head: bytes | bytearray) -> str:
    """Header lines as UTF-8, or, where they are not, as Latin-1."""
    try:
        return head.decode("utf-8")
    except UnicodeDecodeError:
        return head.decode("latin-1")


def headers_of(lines: list[str]) -> dict[str, str]:
    """Values by lower-cased name; a line that begins with white space goes on with the one before; of repeated names the last counts."""
    found, name = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and name is not None:
            found[name] = f"{found[name]} {line.strip()}".strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def parse(file: pa.NativeFile, wanted: dict[str, set[str]], with_payload: bool) -> Iterator[tuple]:
    """Rows of ``SCHEMA`` for the records whose headers have one of the wanted values."""
    source = _Source(file)
    while source.begin():
        head_end = source.find(b"\r\n\r\n")
        if head_end < 0:
            if bytes(source.plain).strip():
                raise ValueError(f"broken WARC record at byte {source.at}")
            return
        lines = text_of(source.plain[: head_end - 4]).split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {source.at}")
        headers = headers_of(lines[1:])
        block = int(headers.get("content-length", 0))
        values = {c: headers.get(h) for c, h in HEADERS.items()}
        values = {c: v if v is None else v.strip("<>") if c == "record_id" else v.removeprefix("sha1:") if c == "payload_digest" else v for c, v in values.items()}
        if all(values[c] in some for c, some in wanted.items()):
            size, payload = block, None
            body = head_end
            if headers.get("content-type", "").startswith("application/http"):
                found = source.find(b"\r\n\r\n", head_end, head_end + block)
                body = found if found >= 0 else head_end + block  # an HTTP header without an end has no payload
                size = head_end + block - body
                if values["record_type"] == "revisit":
                    length = headers_of(text_of(source.plain[head_end:body]).split("\r\n")).get("content-length", "")
                    size = int(length) if length.isdigit() else 0
            if with_payload and values["record_type"] != "revisit":
                source.need(head_end + block)
                payload = bytes(source.plain[body : head_end + block])
            page, refers = (headers.get(h, "").strip("<>").removeprefix(_URN) for h in ("warc-record-id", "warc-refers-to"))
            yield (int(page) if page.lstrip("-").isdigit() else None, values["record_type"], values["target_uri"], values["record_id"], values["payload_digest"], int(refers) if refers.lstrip("-").isdigit() else None, size, payload)
        source.skip(head_end + block + 4)


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.with_payload = options.get("payload", "true").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo | EqualNullSafe) else set(f.value) if isinstance(f, In) else None
            column = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if column in HEADERS:
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self):
        files, root = filesystem(self.path)
        found = files.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        shares: list[Files] = []
        held = self.partition_bytes
        for info in sorted(found, key=lambda x: x.path):
            if info.is_file and info.path.endswith((".warc", ".warc.gz")) and info.size:
                if held + info.size > self.partition_bytes:
                    shares.append(Files([]))
                    held = 0
                shares[-1].paths.append(info.path)
                held += info.size
        return shares or [Files([])]

    def read(self, partition: Files):
        files, _ = filesystem(self.path)
        schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("record_id", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for path in partition.paths:
            with files.open_input_file(path) as file:
                for row in parse(file, self.wanted, self.with_payload):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) >= 2000 or held >= 8 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    """Takes rows of ``page_id, url, html, digest (hex), refers_to``."""

    def __init__(self, options: dict[str, str]):
        self.path, self.date, self.job = options["path"], options.get("date", "1970-01-01T00:00:00Z"), uuid.uuid4().hex
        self.max_file_bytes = int(options.get("max_file_bytes", MAX_FILE_BYTES))

    def write(self, iterator: Iterable[pa.RecordBatch]) -> Written:
        files, root = filesystem(self.path)
        files.create_dir(root, recursive=True)
        paths, out, size = [], None, 0
        for batch in iterator:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for page_id, url, html, digest, refers_to in zip(*columns, strict=True):
                if out is None or size >= self.max_file_bytes:
                    if out is not None:
                        out.close()
                    paths.append(f"{root}/part-{self.job}-{uuid.uuid4().hex}.warc.gz.writing")
                    out, size = files.open_output_stream(paths[-1]), 0
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                data = member(record(page_id.as_py(), url.as_py(), payload, base32(digest.as_py()), refers_to.as_py(), self.date))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(paths)

    def commit(self, messages):
        files, _ = filesystem(self.path)
        for path in (p for m in messages if m for p in m.paths):
            files.move(path, path.removesuffix(".writing"))
        self.abort([])

    def abort(self, messages):
        """Removes what tasks of this job, failed and repeated ones too, left unfinished."""
        files, root = filesystem(self.path)
        for info in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(f"part-{self.job}-") and info.base_name.endswith(".writing"):
                files.delete_file(info.path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known; the session passes filters to Python data sources from here on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows for the writer: of equal payloads of at least ``min_bytes``, the largest id is the response of the others.

    Only digests that occur more than once are joined: broadcast while they are few, else by a shuffle
    whose hot digests adaptive execution splits.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    sized = rows.filter(F.octet_length("html") >= min_bytes)
    repeated = sized.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1").select("digest", "response")
    repeated = materialize(repeated, "digests")
    few = repeated.count() <= MAX_BROADCAST_DIGESTS
    joined = rows.join(F.broadcast(repeated) if few else repeated, "digest", "left")
    revisit = (F.col("page_id") != F.col("response")) & (F.octet_length("html") >= min_bytes)
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("response")).alias("refers_to"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    register(pages.sparkSession)
    small_batches(pages.sparkSession)
    with_revisits(pages, min_bytes).write.format("warc").option("date", date).mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def base32_of(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of bytes: forty bits of it give eight digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back: responses by their payloads, revisits by their headers."""
    path = scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    whole = read(spark, path).filter("record_type = 'response'").withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_of(F.col("payload"))})
    heads = read(spark, path, payload=False).filter("record_type = 'revisit'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return whole.select(columns).unionByName(heads.select(columns))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS response FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  translate(concat(to_base(CAST('0x' || substr(h, 1, 10) AS BIGINT), 32, 8), to_base(CAST('0x' || substr(h, 11, 10) AS BIGINT), 32, 8),
    to_base(CAST('0x' || substr(h, 21, 10) AS BIGINT), 32, 8), to_base(CAST('0x' || substr(h, 31, 10) AS BIGINT), 32, 8)),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  if(page_id = response, 'response', 'revisit') AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to
FROM r
"""
