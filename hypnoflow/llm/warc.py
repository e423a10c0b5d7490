"""WARC archives as a PySpark Python data source, `warc`.

Writing: every task writes gzip members, one a record, to files of its own of about FILE_BYTES each; only the names in a
manifest, written when the whole job has succeeded, belong to the archive, so retried and lost tasks leave nothing in it.
A member's gzip header says how long the member and what it holds are (extra field `sl`).

Reading: a partition is a file, of the manifest or, where there is none, any .warc or .warc.gz below the path. Filters on
warc_type and on header columns are pushed down: a record's headers are parsed first, and a record that they exclude is
passed over by seeking to the next: its payload is not read, decoded or kept. With option payload=false no payload is.
In members of other writers, which do not say their length or hold several records, what is not wanted must be inflated to be
passed over, but nothing of it is kept. Spark asks for spark.sql.python.filterPushdown.enabled; read_archive sets it. Spark keeps what
was pushed with the loaded source, so a query that filters an archive in two ways must load it twice.

Payloads are what follows the HTTP headers in responses, and the whole block of records that are not HTTP; encodings of
the HTTP message are left as they are. Revisits have none.

Archives of other writers: a member may hold any number of records, or a part of one may be missing. Blank lines before a record are passed over.
A record that has no end of headers within HEADERS_MOST bytes, no WARC version or no length, or is cut short, and a member that cannot be inflated, are
malformed: an error, or, with option malformed=row, a row of warc_type `malformed` whose target_uri says which file, at which byte, and what is
wrong; reading goes on with the next member that begins with a record, or the next line of a plain file that does. Records of the same member before the
malformed one are kept.

Defined results: a null payload is an empty one; a null url is an empty one; equal payloads of at least REVISIT_BYTES
are written once, as the response of the largest page_id, and referred to by the others (rows that repeat this page_id
are responses too, a null page_id is always a revisit unless all are null); record ids are unique whatever the rows; an empty
table makes an empty archive.
"""

from __future__ import annotations

import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import broadcastable, durable

REVISIT_BYTES = 1000
#: Bytes read from a file at once, and of a record at first, for its headers.
BLOCK, HEAD = 1 << 18, 1 << 10
#: Headers longer than this are none.
HEADERS_MOST = 1 << 20
#: What a row of the revisits' table takes when it is broadcast.
REVISIT_ROW = 128
FILE_BYTES = 64 << 20
MANIFEST = "manifest.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What each column is read from.
HEADERS = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-X-Refers-To-Page",
    "payload_length": "WARC-X-Payload-Length",
    "page_id": "WARC-X-Page-ID",
}
SCHEMA = "warc_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, payload_length string, page_id string, payload binary"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it, of a local path or a URI as Hadoop writes them."""
    if re.match(r"^[a-z][a-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def member_bytes(record: bytes) -> bytes:
    """A gzip member that says in its header how long it and what it holds are (0 where four bytes cannot say it)."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush() + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    lengths = (24 + len(body), len(record)) if 24 + len(body) < 1 << 32 and len(record) < 1 << 32 else (0, 0)
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, *lengths) + body


def member_lengths(start: bytes) -> tuple[int, int]:
    """The lengths of the gzip member that starts so and of what it holds; 0 where it does not say."""
    if len(start) < 12 or not start[3] & 4:
        return 0, 0
    at, end = 12, 12 + struct.unpack_from("<H", start, 10)[0]
    while at + 4 <= min(end, len(start)):
        name, size = struct.unpack_from("<2sH", start, at)
        if name == b"sl" and size == 8 and at + 12 <= len(start):
            return struct.unpack_from("<II", start, at + 4)
        at += 4 + size
    return 0, 0


def record_bytes(row: dict, record_id: str) -> bytes:
    """One record, not yet compressed."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    one_line = lambda x: re.sub(r"[\r\n]+", " ", x or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        f"WARC-Target-URI: {one_line(row['url'])}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"WARC-X-Payload-Length: {len(payload)}",
        f"WARC-X-Page-ID: {'' if row['page_id'] is None else row['page_id']}",
    ]
    if revisit:
        lines += [f"WARC-X-Refers-To-Page: {row['refers_to']}", f"WARC-Profile: {PROFILE}"]
    lines += [f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, path = located(self.path)
        system.create_dir(path, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for i in range(batch.num_rows):  # one row at a time: payloads may be large
                row = {c: batch[c][i].as_py() for c in batch.schema.names}
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(posixpath.join(path, files[-1]), compression=None), 0
                record_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{files[-1]}/{size}")
                size += out.write(member_bytes(record_bytes(row, str(record_id))))
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = located(self.path)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(posixpath.join(path, MANIFEST)) as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, path = located(self.path)
        for name in (f for m in messages if m for f in m.files):
            system.delete_file(posixpath.join(path, name))


@dataclass
class ArchiveFile(InputPartition):
    path: str


class Window:
    """Reads a file a piece at a time, at any place; `inflated` counts what its members gave."""

    def __init__(self, f: pa.NativeFile) -> None:
        self.f, self.start, self.data, self.size, self.inflated = f, 0, b"", f.size(), 0

    def get(self, at: int, n: int) -> bytes:
        """n bytes from `at` on, fewer at the end of the file."""
        if not self.start <= at or at + n > self.start + len(self.data) and self.start + len(self.data) < self.size:
            self.f.seek(at)
            self.start, self.data = at, self.f.read(max(n, BLOCK))
        return self.data[at - self.start : at - self.start + n]


class Malformed(ValueError):
    """What is read is no record."""


class Plain:
    """The bytes of a file as they are, from a place on."""

    def __init__(self, window: Window, at: int) -> None:
        self.window, self.start, self.at = window, at, at

    def read(self, n: int) -> bytes:
        piece = self.window.get(self.at, n)
        self.at += len(piece)
        return piece

    def skip(self, n: int) -> bool:
        """Passes over n bytes; False if there are not so many."""
        self.at += n
        return self.at <= self.window.size

    def last(self, end: int) -> bool:
        return False

    def after(self) -> int:
        return self.window.size


class Member:
    """What a gzip member holds."""

    def __init__(self, window: Window, at: int) -> None:
        self.window, self.start, self.at = window, at, at
        self.length, self.holds = member_lengths(window.get(at, 64))
        self.inflate = zlib.decompressobj(31)

    def read(self, n: int) -> bytes:
        while not self.inflate.eof:
            rest = self.inflate.unconsumed_tail or self.window.get(self.at, 1 << 14)
            if not rest:
                raise Malformed("a gzip member ends too early")
            self.at += 0 if self.inflate.unconsumed_tail else len(rest)
            try:
                piece = self.inflate.decompress(rest, n)
            except zlib.error as wrong:
                raise Malformed(f"a gzip member cannot be inflated: {wrong}") from None
            self.window.inflated += len(piece)
            if piece:
                return piece
        return b""

    def skip(self, n: int) -> bool:
        while n:
            piece = self.read(min(n, 1 << 16))
            if not piece:
                return False
            n -= len(piece)
        return True

    def last(self, end: int) -> bool:
        """Whether nothing comes after a record that ends there, as far as the member says what it holds."""
        return self.length > 0 and end == self.holds

    def after(self) -> int:
        """Where the next member begins; this one has been read to its end, or says how long it is."""
        return self.at - len(self.inflate.unused_data) if self.inflate.eof else self.start + self.length


class Feed:
    """A source with what has been read from it but not been used."""

    def __init__(self, source: Plain | Member) -> None:
        self.source, self.held, self.used, self.begun = source, b"", 0, 0  # begun: where the record that is read begins

    def more(self, n: int) -> bool:
        piece = self.source.read(n)
        self.held += piece
        return bool(piece)

    def take(self, n: int) -> bytes:
        """n bytes, fewer at the end."""
        pieces, have = [self.held[:n]], min(len(self.held), n)
        self.held = self.held[n:]
        while have < n:
            piece = self.source.read(n - have)
            if not piece:
                break
            pieces.append(piece)
            have += len(piece)
        self.used += have
        return b"".join(pieces)

    def skip(self, n: int) -> bool:
        self.used += n
        here = min(len(self.held), n)
        self.held = self.held[here:]
        return here == n or self.source.skip(n - here)

    def head(self) -> bytes | None:
        """The next record's headers, without the blank lines before them; None at the end."""
        while True:
            if not self.held and not self.more(HEAD):
                return None
            rest = self.held.lstrip(b"\r\n")
            self.used += len(self.held) - len(rest)
            self.held, self.begun = rest, self.used
            if rest:
                break
        seen = 0
        while (end := self.held.find(b"\r\n\r\n", seen)) < 0:
            if not self.held.startswith(b"WARC/"[: len(self.held)]):
                raise Malformed("no WARC version where a record should begin")
            seen = max(len(self.held) - 3, 0)
            if len(self.held) > HEADERS_MOST or not self.more(HEAD):
                raise Malformed("a record without the end of its headers")
        return self.take(end + 4)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, malformed: str = "fail") -> None:
        if malformed not in ("fail", "row"):
            raise ValueError(f"malformed is fail or row, not {malformed}")
        self.path, self.payload, self.malformed = path, payload, malformed
        self.wanted: dict[str, set[str]] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else None
            if isinstance(f, (EqualTo, In)) and column in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            elif isinstance(f, IsNotNull) and column in HEADERS:
                self.present.add(column)
            else:
                yield f

    def partitions(self) -> list[ArchiveFile]:
        system, path = located(self.path)
        if system.get_file_info(path).type == fs.FileType.File:
            return [ArchiveFile(self.path)]
        try:
            with system.open_input_stream(posixpath.join(path, MANIFEST)) as f:
                names = json.loads(f.read())
        except FileNotFoundError:
            found = (i.path for i in system.get_file_info(fs.FileSelector(path, recursive=True)))
            names = sorted(posixpath.relpath(x, path) for x in found if x.lower().endswith((".warc", ".warc.gz")))
        return [ArchiveFile(posixpath.join(self.path, n)) for n in names] or [ArchiveFile("")]

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        if partition.path:
            system, path = located(partition.path)
            with system.open_input_file(path) as f:
                yield from self.batches(Window(f), partition.path)

    def batches(self, window: Window, name: str = "") -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.string()) for c in HEADERS] + [("payload", pa.binary())])
        rows, held = [], 0
        for row in self.rows(window, name):
            rows.append(row)
            held += len(row["payload"] or b"")
            if len(rows) >= 1000 or held >= 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def rows(self, window: Window, name: str) -> Iterator[dict]:
        at = 0
        while at < window.size:
            if window.get(at, 1) in (b"\r", b"\n", b"\0"):
                at += 1
                continue
            zipped = window.get(at, 2) == b"\x1f\x8b"
            source = Member(window, at) if zipped else Plain(window, at)
            feed = Feed(source)
            try:
                while True:
                    head = feed.head()
                    if head is None:
                        break
                    row, ends = self.record(feed, head)
                    if row is not None:
                        yield row
                    if ends:
                        break
                at = source.after()
            except Malformed as wrong:
                begun = at if zipped else at + feed.begun
                if self.malformed == "fail":
                    raise ValueError(f"{name}, byte {begun}: {wrong}") from None
                told = {c: None for c in (*HEADERS, "payload")} | {"warc_type": "malformed", "target_uri": f"{name}:{begun}: {wrong}"}
                if self.wants(told):
                    yield told
                at = next_record(window, begun + 1)

    def wants(self, row: dict) -> bool:
        return all(row[c] in values for c, values in self.wanted.items()) and all(row[c] is not None for c in self.present)

    def record(self, feed: Feed, head: bytes) -> tuple[dict | None, bool]:
        """The record's columns, or None where its headers exclude it, and whether its member is known to end with it."""
        first, *lines = head[:-4].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise Malformed("no WARC version where a record should begin")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        if not fields.get("content-length", "").isdecimal():
            raise Malformed("a record without its length")
        length = int(fields["content-length"])
        row = {c: fields.get(h.lower()) or None for c, h in HEADERS.items()}
        row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
        row["record_id"] = row["record_id"] and row["record_id"].removeprefix("<").removesuffix(">")
        row["payload"] = None
        ends = feed.source.last(feed.used + length + 4)
        wanted = self.wants(row)
        if wanted and self.payload and row["warc_type"] != "revisit":
            block = feed.take(length)
            if len(block) < length:
                raise Malformed("a record shorter than it says")
            row["payload"] = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
        elif not ends and not feed.skip(length):
            raise Malformed("a record shorter than it says")
        return row if wanted else None, ends


def next_record(window: Window, at: int) -> int:
    """The first place from `at` on where a gzip member that begins with a record, or a line with a record's version, begins; the file's end if none does."""
    while at < window.size:
        piece = window.get(at, BLOCK)
        for m in re.finditer(rb"\x1f\x8b\x08|\nWARC/", piece):
            here = at + m.start()
            if m[0] == b"\nWARC/":
                return here + 1
            try:
                if zlib.decompressobj(31).decompress(window.get(here, 1 << 12), 5) == b"WARC/":
                    return here
            except zlib.error:
                pass
        if at + len(piece) >= window.size:
            break
        at += max(len(piece) - 8, 1)
    return window.size


class WarcSource(DataSource):
    """Options: path; payload (true: payloads of responses are read); malformed (fail, or row)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false", self.options.get("malformed", "fail"))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """What is to be written: page_id, url, payload, payload_digest, record_type, refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marked = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("payload_digest"))
    large = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.sha1(payload).alias("payload_digest"), F.octet_length(payload).alias("n")).where(F.col("n") >= least)
    first = large.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    # only digests that repeat meet their copies: narrow rows; the payloads are not shuffled if the list of revisits is small, else by page_id
    again = large.join(first, "payload_digest").where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = again.select(F.col("page_id").alias("again_id"), F.col("payload_digest").alias("again_digest"), "refers_to").distinct()
    both = marked.join(broadcastable(durable(again), REVISIT_ROW), F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("payload_digest") == F.col("again_digest")), "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return both.select("page_id", "url", "payload", "payload_digest", kind.alias("record_type"), "refers_to")


def write_archive(pages: DataFrame, path: str, least: int = REVISIT_BYTES) -> None:
    pages.sparkSession.dataSource.register(WarcSource)
    records(pages, least).write.format("warc").mode("append").save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True, malformed: str = "fail") -> DataFrame:
    """The records of the archive or file at path; to be loaded anew for each set of filters in one query."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).option("malformed", malformed).load(path)
