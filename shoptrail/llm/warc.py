"""WARC archives with Zstandard: one frame per record, and the dictionary of an archive in a leading skippable frame.

Equal payloads (SHA-1) of at least `least` bytes are written once, as the response of the largest page_id; the other pages
get revisit records that refer to it. The reader loads the dictionary, decodes frame by frame, and checks versions,
headers, lengths and digests.

Defined cases: a null html is an empty payload; a null url is 'urn:page:none'; a null page_id is written as 'none', never
is the response of a group that has other ids, and stays null when read; repeated rows are repeated records (all rows that
carry the largest page_id of a payload are responses); white space and control characters in a URL are percent-encoded, so
that they cannot end a header line; a record larger than an archive has an archive of its own; no rows, no archives.
"""
from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import put
from .shared import folder, stage

#: Fixed values of the formats: magic number of the dictionary's skippable frame, of a Zstandard frame, and record marks.
SKIPPABLE, FRAME, VERSION = 0x184D2A5D, 0xFD2FB528, b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE = 8 << 20   # compressed bytes after which an archive is closed
SAMPLES = 1 << 20   # bytes of records that the dictionary of an archive is made from
DICTIONARY = 1 << 14
STEP = 1 << 16      # compressed bytes that are looked at at once
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


class Broken(ValueError):
    """An archive that does not keep the format."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, response_id: int | None) -> bytes:
    """One record: a response, or a revisit if response_id is another page's."""
    name = lambda x: f"<urn:page:{'none' if x is None else x}>"
    revisit = response_id is not None and response_id != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "urn:page:none")
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Target-URI", target),
             ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
             ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        lines += [("WARC-Refers-To", name(response_id)), ("WARC-Profile", PROFILE)]
    lines.append(("Content-Length", str(len(block))))
    head = b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in lines), b"", b""])
    return head + block + b"\r\n\r\n"


class Archive:
    """Collects records; the first ones make the dictionary."""

    def __init__(self):
        self.waiting: list[bytes] = []
        self.size = self.records = 0
        self.parts: list[bytes] = []
        self.compressor = None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.compressor is None:
            self.waiting.append(data)
            self.size += len(data)
            if self.size >= SAMPLES:
                self._start()
        else:
            self._write(data)

    def _write(self, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.parts.append(frame)
        self.size += len(frame)

    def _start(self) -> None:
        samples = [x[:DICTIONARY] for x in self.waiting]
        try:
            trained = zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
        except zstandard.ZstdError:  # too few or too small samples: the first record's head serves as raw content
            trained = b"".join(samples)[:DICTIONARY]
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
        self.parts, waiting, self.waiting = [struct.pack("<II", SKIPPABLE, len(trained)) + trained], self.waiting, []
        self.size = 0
        for data in waiting:
            self._write(data)

    def full(self) -> bool:
        return self.compressor is not None and self.size >= ARCHIVE

    def bytes(self) -> bytes:
        if self.compressor is None:
            self._start()
        return b"".join(self.parts)


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded records of an archive, one frame each."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        raise Broken("no dictionary frame at the start")
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise Broken("the dictionary frame is cut off")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
    view, at = memoryview(data), 8 + size
    while at < len(data):
        if len(data) - at < 4 or struct.unpack_from("<I", data, at)[0] != FRAME:
            raise Broken(f"no frame at byte {at}")
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise Broken("the last frame is cut off")
            try:
                out.append(frame.decompress(view[at:at + STEP]))
            except zstandard.ZstdError as wrong:
                raise Broken(str(wrong)) from wrong
            at += min(STEP, len(data) - at)
        at -= len(frame.unused_data)
        yield b"".join(out)


def headers(block: bytes) -> tuple[bytes, dict[str, str], int]:
    """First line, header fields (lower-case names) and the place behind the empty line."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise Broken("headers without an end")
    first, *lines = block[:end].split(b"\r\n")
    fields = {}
    for line in lines:
        key, colon, value = line.partition(b": ")
        if not colon or not key or key.decode().lower() in fields:
            raise Broken(f"header line {line[:80]!r}")
        fields[key.decode().lower()] = value.decode()
    return first, fields, end + 4


def length(fields: dict[str, str]) -> int:
    if not re.fullmatch(r"[0-9]+", fields.get("content-length", "")):
        raise Broken("no Content-Length")
    return int(fields["content-length"])


def parse(data: bytes) -> tuple:
    """A record's fields as FIELDS; a revisit's payload is null. Raises Broken where a header, length or digest is wrong."""
    version, fields, start = headers(data)
    if version != VERSION:
        raise Broken(f"version {version[:20]!r}")
    size = length(fields)
    if len(data) != start + size + 4 or not data.endswith(b"\r\n\r\n"):
        raise Broken(f"a block of {len(data) - start - 4} bytes, {size} declared")
    block = data[start:start + size]
    if fields.get("warc-block-digest") != f"sha1:{base32_sha1(block)}":
        raise Broken("block digest")
    status, http, body = headers(block)
    if not status.startswith(b"HTTP/1."):
        raise Broken("no HTTP block")
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "")
    ids = [re.fullmatch(r"<urn:page:(none|-?[0-9]+)>", fields.get(x, "")) for x in ("warc-record-id", "warc-refers-to")]
    number = lambda m: None if m is None or m[1] == "none" else int(m[1])
    if ids[0] is None or not re.fullmatch(r"sha1:[A-Z2-7]{32}", digest) or "warc-target-uri" not in fields:
        raise Broken("a header is missing")
    payload = block[body:]
    if kind == "response":
        if length(http) != len(payload) or digest != f"sha1:{base32_sha1(payload)}":
            raise Broken("payload length or digest")
    elif kind != "revisit" or ids[1] is None or payload or fields.get("warc-profile") != PROFILE:
        raise Broken(f"record type {kind}")
    return (number(ids[0]), length(http), digest[5:], kind, number(ids[1]), fields["warc-target-uri"],
            payload if kind == "response" else None)


def write_archives(pages: DataFrame, into: str, least: int = 0) -> DataFrame:
    """Writes pages (page_id, url, html) as archives below the folder `into`. Returns one row per archive: archive, records,
    bytes. A name holds the attempt of its task, and only the files of attempts that ended are listed."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    digest = F.when(F.octet_length("payload") >= least, F.sha1("payload"))
    copies = (rows.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.max("page_id").alias("response_id"))
              .filter("n > 1 AND digest IS NOT NULL").select("digest", "response_id"))
    told = rows.withColumn("digest", digest).join(copies, "digest", "left").select("page_id", "url", "payload", "response_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, now = TaskContext.get(), 0, Archive()

        def close() -> pa.RecordBatch:
            data = now.bytes()
            name = f"pages-{task.partitionId():05d}-{made:05d}-{task.taskAttemptId()}.warc.zst"
            put(into, name, data)
            return pa.RecordBatch.from_pydict({"archive": [name], "records": [now.records], "bytes": [len(data)]})

        for batch in batches:
            for page_id, url, payload, response_id in zip(*(c.to_pylist() for c in batch.columns)):
                now.add(record(page_id, url, payload, response_id))
                if now.full():
                    yield close()
                    made, now = made + 1, Archive()
        if now.records:
            yield close()

    return stage(told.mapInArrow(write, "archive string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, folder_: str, payloads: bool = True) -> DataFrame:
    """The records of the listed archives (column archive) in a folder, as FIELDS (without the payload column if not asked for)."""
    spark = archives.sparkSession
    fields = FIELDS if payloads else FIELDS.removesuffix(", payload binary")
    names = [f.split()[0] for f in fields.split(", ")]
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]])
                        for n, f in zip(names, fields.split(", "))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows, held = [], 0
                for frame in frames(data.as_py()):
                    rows.append(parse(frame)[:len(names)])
                    held += len(frame)
                    if held >= ARCHIVE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    if archives.isEmpty():
        return spark.createDataFrame([], fields)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder_)
    listed = files.withColumn("archive", F.element_at(F.split("path", "/"), -1)).join(archives, "archive", "left_semi")
    return listed.select("content").mapInArrow(read, fields)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back."""
    into = folder(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages, into), into, payloads=False).drop("url")
