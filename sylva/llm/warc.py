"""WARC archives as a Python data source.

``spark.read.format("warc")`` plans partitions over the archives of a folder by size.
Predicates on the record type and on header columns are pushed down: a record's headers
are parsed first, and the payload of a record that they rule out (or every payload, with
``payload`` false) is neither inflated nor decoded: each record is a gzip member of its
own that names its compressed size in the ``sl`` extra field of the WARC standard, so the
reader goes on behind it. Members without that field are inflated through and dropped.

``df.write.format("warc")`` writes the same columns. Tasks write under names of their own
in ``_pending``; the commit gives the files of the tasks that count their final names, so a
task that runs twice or is lost leaves nothing behind.

Archives of other writers: digests may be by MD5 or any SHA and in base32 or hexadecimal of either case
(of unknown algorithms they are passed on, not checked); headers may go on in a second line; a
record without Content-Length ends with its gzip member, and without one is an error. An archive is
read by one task, so archives of some hundred MB, as crawlers write them, keep tasks even.

Paths are of any file system that pyarrow knows. Filter pushdown of Python sources is a
session setting, ``spark.sql.python.filterPushdown.enabled``; :func:`read_warc` sets it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In,
                                    InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage)

#: Columns and the headers that they come from.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
           "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_bytes bigint, payload binary"
#: Bytes of the digests that can be checked.
SIZES = {"md5": 16, "sha1": 20, "sha256": 32, "sha384": 48, "sha512": 64}
SPLIT_BYTES, FILE_BYTES, HEAD = 64 << 20, 256 << 20, 2048


def filesystem(path: str):
    """(file system, path on it)."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int) -> bytes:
    """One gzip member with the sizes of itself and of ``data`` in the extra field."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 24 + len(body) + 8
    sizes = (size, len(data)) if max(size, len(data)) < 1 << 32 else (0, 0)  # 0: not named
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, *sizes)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def plain_digest(named: str | None) -> str | None:
    """A payload digest as the reader gives it: bare upper-case base32 for SHA-1, whichever way it was
    written (hexadecimal, lower case, with or without the algorithm); for others algorithm:value,
    hexadecimal in lower case and base32 in upper."""
    if not named:
        return None
    algorithm, _, value = named.rpartition(":")
    algorithm, value = algorithm.strip().lower().replace("-", "") or "sha1", value.strip()
    size = SIZES.get(algorithm)
    if size and len(value) == 2 * size and re.fullmatch("[0-9a-fA-F]+", value):
        value = value.lower() if algorithm != "sha1" else base64.b32encode(bytes.fromhex(value)).decode()
    elif size:
        value = value.rstrip("=").upper()
    return value if algorithm == "sha1" else f"{algorithm}:{value}"


def digest_like(digest: str, payload: bytes) -> str:
    """The payload's digest in the form of ``digest``; that itself where its algorithm isn't known."""
    algorithm, _, value = digest.rpartition(":")
    size = SIZES.get(algorithm or "sha1")
    if not size:
        return digest
    own = hashlib.new(algorithm or "sha1", payload).digest()
    own = own.hex() if len(value) == 2 * size else base64.b32encode(own).decode().rstrip("=")
    return f"{algorithm}:{own}" if algorithm else own


def record(row: dict, date: str) -> bytes:
    """The record of a row: an HTTP response, or a revisit that has its headers alone."""
    clean = lambda v: "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in v)
    payload = row["payload"] if row["record_type"] == "response" else None
    digest = row["payload_digest"] or (None if payload is None else sha1_base32(payload))
    if digest and len(digest) == 40:  # as hex
        digest = base64.b32encode(bytes.fromhex(digest)).decode()
    size = len(payload) if payload is not None else row["payload_bytes"] or 0
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    values = {**row, "date": row["date"] or date, "payload_digest": digest and f"sha1:{digest}"}
    lines = ["WARC/1.1"] + [f"{h}: {clean(values[c])}" for c, h in HEADERS.items() if values[c] is not None]
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload or b'')}", "", ""]
    return "\r\n".join(lines).encode() + http + (payload or b"") + b"\r\n\r\n"


class WarcSource(DataSource):
    """Options: path; payload (true); verify (true: a payload must have its digest);
    splitbytes; for writing filebytes, level and date (of records that have none)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.filters = options, []
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "true").lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In, StringStartsWith, IsNotNull, IsNull)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for f in self.filters:
            v = row.get(f.attribute[0])
            if isinstance(f, IsNull):
                ok = v is None
            elif isinstance(f, EqualNullSafe):
                ok = v == f.value
            elif v is None:
                ok = False
            elif isinstance(f, EqualTo):
                ok = v == f.value
            elif isinstance(f, In):
                ok = v in f.value
            else:
                ok = isinstance(f, IsNotNull) or v.startswith(f.value)
            if not ok:
                return False
        return True

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        files, root = filesystem(self.options["path"])
        infos = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        found = sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and i.path.endswith((".warc", ".warc.gz")) and "/_pending/" not in i.path)
        limit, bins, size = int(self.options.get("splitbytes", SPLIT_BYTES)), [], 0
        for path, n in found:
            if not bins or size + n > limit:
                bins.append([])
                size = 0
            bins[-1].append(path)
            size += n
        return [Files(b) for b in bins] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(self.options["path"])
        schema = pa.schema([(c, pa.string()) for c in HEADERS] + [("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows, size = [], 0
        for path in partition.paths:
            with files.open_input_file(path) as f:
                for row in self.records(f, path.endswith(".gz")):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 300
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, f, packed: bool) -> Iterator[dict]:
        at, end = 0, f.size()
        while at < end:
            f.seek(at)
            stream = Member(f, at) if packed else Plain(f)
            head = stream.until(b"\r\n\r\n")
            if not head.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at byte {at}")
            # A line that begins with a blank goes on with the one before it.
            lines = [x.partition(":") for x in re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")[1:]]
            headers = {k.strip().lower(): v.strip() for k, _, v in lines}
            if "content-length" not in headers and not packed:
                raise ValueError(f"the WARC record at byte {at} has no Content-Length")
            length = int(headers["content-length"]) if "content-length" in headers else stream.rest()
            row = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
            digest = row["payload_digest"] = plain_digest(row["payload_digest"])
            if self.wanted(row):
                is_http = headers.get("content-type", "").startswith("application/http")
                http = stream.until(b"\r\n\r\n") if is_http and length else b""
                left = length - len(http)
                row["payload_bytes"], row["payload"] = left, None
                if row["record_type"] == "revisit":
                    named = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    row["payload_bytes"] = int(named[0]) if named else None
                elif self.payload:
                    row["payload"] = stream.exactly(left)
                    if self.verify and digest and digest != digest_like(digest, row["payload"]):
                        raise ValueError(f"the payload of {row['record_id']} differs from its digest")
                yield row
            at = stream.next_at(at, len(head) + length + 4)


class Plain:
    """Reads an uncompressed record from where the file stands."""

    def __init__(self, f):
        self.f, self.buffer = f, b""

    def more(self) -> bytes:
        return self.f.read(HEAD)

    def until(self, mark: bytes) -> bytes:
        """Up to and with ``mark``."""
        while (k := self.buffer.find(mark)) < 0:
            if not (data := self.more()):
                raise ValueError("a WARC record ends early")
            self.buffer += data
        out, self.buffer = self.buffer[:k + len(mark)], self.buffer[k + len(mark):]
        return out

    def exactly(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            if not (data := self.more()):
                raise ValueError("a WARC record ends early")
            parts.append(data)
            have += len(data)
        data = b"".join(parts)
        self.buffer = data[n:]
        return data[:n]

    def rest(self) -> int:
        """Reads on to the end; how many bytes are left but for the record's closing blank lines."""
        parts = [self.buffer]
        while data := self.more():
            parts.append(data)
        self.buffer = b"".join(parts)
        return len(self.buffer.removesuffix(b"\r\n\r\n"))

    def next_at(self, at: int, size: int) -> int:
        return at + size


class Member(Plain):
    """Inflates the gzip member that begins at ``at``, as far as it is asked for."""

    def __init__(self, f, at: int):
        super().__init__(f)
        self.inflate, self.size, self.read = zlib.decompressobj(31), None, 0
        self.raw = f.read(HEAD)
        if len(self.raw) >= 24 and self.raw[3] & 4 and self.raw[12:14] == b"sl":
            self.size = struct.unpack("<I", self.raw[16:20])[0] or None

    def more(self) -> bytes:
        while not self.inflate.eof:
            raw, self.raw = self.raw or self.f.read(1 << 16), b""
            if not raw:
                return b""
            self.read += len(raw)
            if data := self.inflate.decompress(raw):
                return data
        return b""

    def next_at(self, at: int, size: int) -> int:
        if self.size:
            return at + self.size
        while not self.inflate.eof:  # no size given: inflate and drop
            if not self.more() and not self.inflate.eof:
                raise ValueError("a WARC record ends early")
        return at + self.read - len(self.inflate.unused_data)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = filesystem(self.options["path"])
        files.create_dir(f"{root}/_pending", recursive=True)
        limit, level = int(self.options.get("filebytes", FILE_BYTES)), int(self.options.get("level", 1))
        date, names, out, size = self.options.get("date", "1970-01-01T00:00:00Z"), [], None, 0
        try:
            for batch in iterator:
                columns = [batch.column(c) if c in batch.schema.names else None for c in (*HEADERS, "payload_bytes", "payload")]
                for k in range(batch.num_rows):  # row by row: payloads can be long
                    row = dict(zip((*HEADERS, "payload_bytes", "payload"), (None if c is None else c[k].as_py() for c in columns)))
                    if out is None or size >= limit:
                        if out is not None:
                            out.close()
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = files.open_output_stream(f"{root}/_pending/{names[-1]}", compression=None), 0
                    size += out.write(member(record(row, date), level))
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = filesystem(self.options["path"])
        files.create_dir(root, recursive=True)
        if self.overwrite:
            for i in files.get_file_info(fs.FileSelector(root)):
                if i.type == fs.FileType.File and i.path.endswith((".warc", ".warc.gz")):
                    files.delete_file(i.path)
        for m in messages:
            for name in m.names if m else ():
                files.move(f"{root}/_pending/{name}", f"{root}/{name}")
        self._clear(files, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*filesystem(self.options["path"]))

    @staticmethod
    def _clear(files, root: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{root}/_pending").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/_pending")


def read_warc(spark: SparkSession, path: str, where: Column | None = None, **options) -> DataFrame:
    """The records under ``path`` that meet ``where``, pushed down where it is on headers."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("warc").options(**options).load(path)
    return df if where is None else df.filter(where)


def write_warc(records: DataFrame, path: str, **options) -> None:
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").options(**options).mode("append").save(path)
