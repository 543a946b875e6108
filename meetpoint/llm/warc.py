"""Zstandard WARC archives: write them from pages, and read them back.

An archive starts with a skippable frame that holds a zstd dictionary and goes
on with one frame per WARC record.  Writers run in Spark tasks and roll over to
a new archive at a size limit; readers take one archive at a time, so memory is
bounded by that limit and by the largest record.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.dataset import shared_uri
from .common import materialise, shared_dir, small_batches

# Fixed values of the formats (WARC 1.1, its Zstandard profile, RFC 8878).
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")

SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 16 << 10


class WarcError(ValueError):
    """An archive or record that is not as the formats require."""


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def header_text(value: str) -> str:
    """``value`` on one line: control characters and blanks are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def build_record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record, a response or (with ``refers_to``) a revisit without payload."""
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = status if refers_to is not None else status + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", header_text(url) if url else f"urn:page:{page_id}"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page", str(refers_to))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode()
    return head + b"\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Headers and payload of a record; raises WarcError where lengths or headers are wrong."""
    head, blank, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or lines[0] != VERSION:
        raise WarcError("not a WARC/1.1 record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"header without a colon: {line[:60]!r}")
        headers[name.decode().strip().lower()] = value.decode().strip()
    if missing := [k for k in MANDATORY if k not in headers]:
        raise WarcError(f"missing headers: {missing}")
    if not headers["content-length"].isdigit():
        raise WarcError("Content-Length is not a number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError("the block's length is not its Content-Length")
    block = rest[:n]
    if headers.get("warc-block-digest", "") not in ("", f"sha256:{hashlib.sha256(block).hexdigest()}"):
        raise WarcError("the block does not match its digest")
    http, blank, payload = block.partition(b"\r\n\r\n")
    if not blank or not http.startswith(b"HTTP/"):
        raise WarcError("the block is not an HTTP message")
    return {"headers": headers, "payload": payload}


def make_dictionary(samples: list[bytes]) -> bytes:
    """A zstd dictionary trained on the samples; raw content where they are too few."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def archive_bytes(records: list[bytes], level: int = 3) -> bytes:
    """The archive of ``records``: dictionary frame, then a frame per record."""
    samples, size = [], 0
    for record in records:
        if size >= SAMPLE_BYTES:
            break
        samples.append(record[: SAMPLE_BYTES // 8])
        size += len(samples[-1])
    dictionary = make_dictionary(samples)
    pressed = zstandard.ZstdCompressor(level=level).compress(dictionary)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    frames = [struct.pack("<II", DICTIONARY_FRAME, len(pressed)), pressed]
    frames += map(compressor.compress, records)
    return b"".join(frames)


def read_dictionary(archive: bytes) -> tuple[bytes, int]:
    """The dictionary of the leading skippable frame and where the records start."""
    if len(archive) < 8:
        raise WarcError("too short for a dictionary frame")
    magic, n = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_FRAME or 8 + n > len(archive):
        raise WarcError("no whole dictionary frame in front")
    dictionary = archive[8 : 8 + n]
    if dictionary[:4] == struct.pack("<I", ZSTD_FRAME):  # the profile allows a compressed dictionary
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    return dictionary, 8 + n


def iter_records(archive: bytes):
    """The records of an archive, one decoded frame at a time."""
    dictionary, at = read_dictionary(archive)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    rest = memoryview(archive)
    while at < len(archive):
        one = reader.decompressobj()
        pieces = []
        while at < len(archive) and not one.eof:
            step = rest[at : at + (1 << 16)]
            pieces.append(one.decompress(step))
            at += len(step)
        if not one.eof:
            raise WarcError("a frame is cut off")
        at -= len(one.unused_data)
        yield b"".join(pieces)


def with_references(pages: DataFrame, min_bytes: int) -> DataFrame:
    """pages(page_id, url, payload) with digest and the page that a revisit refers to.

    Only digests and ids are grouped.  The groups' first pages, which are few,
    are joined by (digest, page), so a large group of copies is spread out.
    """
    digested = pages.withColumn("digest", F.sha2("payload", 256))
    narrow = digested.where(F.length("payload") >= min_bytes).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    later = materialise(
        narrow.where("page_id is not null").distinct()
        .join(first.where("last > refers_to").drop("last"), "digest")
        .where("page_id > refers_to")
        .withColumnRenamed("page_id", "p").withColumnRenamed("digest", "d")
    )
    return digested.join(later, F.expr("page_id = p and digest = d"), "left").drop("p", "d")


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 100, archive_size: int = 16 << 20, date: str = "2026-01-01T00:00:00Z"
) -> DataFrame:
    """Write pages(page_id, url, html) as archives below ``folder``; a row per archive.

    The result (file, records, bytes) names the archives of the tasks that
    succeeded: a task that is run again writes files of another name, and the
    reader takes only what the manifest names.
    """
    uri = shared_uri(pages.sparkSession, folder)  # as the reader finds the folder
    payloads = small_batches(pages).select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))

    def write(batches):
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path, recursive=True)
        records, size = [], 0

        def flush():
            name = f"{uuid.uuid4().hex}.warc.zst"
            data = archive_bytes(records)
            with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
                out.write(data)
            return pd.DataFrame({"file": [name], "records": [len(records)], "bytes": [len(data)]})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for page_id, url, payload, digest, refers_to in zip(*columns, strict=True):
                records.append(build_record(page_id, url, payload, digest, refers_to, date))
                size += len(records[-1])
                if size >= archive_size:
                    yield flush()
                    records, size = [], 0
        if records:
            yield flush()

    def write_arrow(batches):
        import pyarrow as pa

        for pdf in write(batches):
            yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    rows = with_references(payloads, min_bytes).select("page_id", "url", "payload", "digest", "refers_to")
    return materialise(rows.mapInArrow(write_arrow, "file string, records long, bytes long"))


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """The records of the archives below ``folder`` (those the manifest names, if given).

    Columns: page_id, target_uri, record_type, payload_bytes, payload_digest,
    refers_to, payload.  Payloads are decoded, measured and hashed again; a
    record that breaks the format, or whose payload is not as its headers say,
    fails the job.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    if manifest is not None:
        files = files.join(manifest.select("file"), "file", "left_semi")

    def read(batches):
        for batch in batches:
            for archive in batch.column("content"):
                rows, size = [], 0
                for record in iter_records(archive.as_py()):
                    parsed = parse_record(record)
                    headers, payload = parsed["headers"], parsed["payload"]
                    kind, length = headers["warc-type"], int(headers["x-payload-length"])
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise WarcError(f"payload of {headers['warc-record-id']} is not as its headers say")
                    number = lambda k: int(headers[k]) if k in headers else None  # noqa: E731, B023
                    rows.append((number("x-page-id"), headers.get("warc-target-uri"), kind, length, digest, number("x-refers-to-page"), payload))
                    size += len(record)
                    if size > 8 << 20:
                        yield as_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield as_batch(rows)

    def as_batch(rows):
        import pyarrow as pa

        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = ("page_id", "target_uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    return files.select("content").mapInArrow(
        read, "page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    )


def archive_round_trip(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back.

    A null html is an empty payload.  Copies share a response only if they have
    ``min_bytes`` or more.  A null page_id is always a response and is never
    referred to.  Rows with the same page_id and payload are alike: all are
    responses if that id is the smallest, else all revisit.  An empty table
    writes nothing and gives no rows.  Other columns of the input are ignored.
    """
    spark = pages.sparkSession
    folder = shared_dir(spark)
    manifest = write_archives(pages, folder, min_bytes)
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id long, target_uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
    return read_archives(spark, folder, manifest)
