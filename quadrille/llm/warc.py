"""WARC archives under Zstandard: writing, reading back and validating.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; each
record is one frame, compressed with that dictionary and with its content size and checksum in the header.
Archives are rows (archive, content): a table of them can be written as Parquet, or come from Spark's
``binaryFile`` source, which reads .warc.zst files of any store.  ``export_archives`` writes files.

Of records with equal payloads of at least ``min_revisit`` bytes, that with the smallest page_id is
the response, others are revisits that refer to it; smaller payloads are all responses.  Which these are is found from ids and
digests alone; payloads are then dealt by both, so that a payload that many pages have is spread over all tasks.

Defined results: a null html is an empty payload; a null url becomes an empty target; records without a page_id are revisits of
the smallest id with their payload, or all responses if no record with an id has it; of repeated page_ids with one payload one is the
response and the others are revisits of it, or all are revisits of a smaller id; an empty table gives no archives.  Columns other
than page_id, url and html, of any name, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chosen_by, sample_threshold, save

DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: The dictionary's size, and the most pages and characters of a page that it is trained on.
DICT_BYTES, DICT_PAGES, DICT_CHARS = 32 << 10, 400, 20_000
#: An archive is closed beyond so many bytes.
ARCHIVE_BYTES = 4 << 20
LEVEL = 3
#: Rows of a batch of records that are read; the key of rows without an id.
ROWS, NO_ID = 1024, -(1 << 63)
OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(pages: DataFrame) -> bytes:
    """From DICT_PAGES pages at most of DICT_CHARS characters at most, chosen by the hash of their id; empty if they are too few."""
    short = pages.filter(F.length("html").between(1, DICT_CHARS))
    limit = sample_threshold(short, F.lit(0), DICT_PAGES)
    rows = short.filter(chosen_by(limit, F.lit(0), F.col("page_id"))).select("html").limit(2 * DICT_PAGES).collect()
    samples = sorted(r.html.encode() for r in rows)
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _header(fields: list[tuple[str, str]]) -> bytes:
    clean = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields) + "\r\n").encode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """A response, or a revisit without its payload; both name the payload's digest and length."""
    name = "none" if page_id is None else str(page_id)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Target-URI", url or ""), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    else:
        block += payload
    return _header([*fields, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary


class ArchiveError(ValueError):
    """An archive that does not hold what its headers say."""


def frame_end(content: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, by its header and those of its blocks; beyond the content if it is cut short."""
    flags = content[at + 4] if at + 4 < len(content) else 0
    single, dict_id, size = flags >> 5 & 1, (0, 1, 2, 4)[flags & 3], (0, 2, 4, 8)[flags >> 6]
    at += 5 + (1 - single) + dict_id + (size or single)
    last = False
    while not last:
        if at + 3 > len(content):
            return len(content) + 1
        head = int.from_bytes(content[at : at + 3], "little")
        last = head & 1
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)  # a block of one repeated byte holds that byte only
    return at + 4 * (flags >> 2 & 1)


def split_archive(content: bytes) -> tuple[bytes, Iterator[bytes]]:
    """The dictionary of the leading skippable frame, and the records, one of each further frame, decoded one by one."""
    if len(content) < 8:
        raise ArchiveError("shorter than a frame header")
    magic, size = struct.unpack_from("<II", content)
    start, dictionary = 0, b""
    if magic == DICT_MAGIC:
        start = 8 + size
        if start > len(content):
            raise ArchiveError("the dictionary is cut short")
        dictionary = content[8:start]
        if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):  # it may itself be compressed
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def records() -> Iterator[bytes]:
        view, at = memoryview(content), start
        while at < len(content):
            if len(content) - at < 4:
                raise ArchiveError("bytes after the last frame")
            if struct.unpack_from("<I", content, at)[0] != FRAME_MAGIC:
                raise ArchiveError(f"no frame at byte {at}")
            end = frame_end(view, at)
            if end > len(content):
                raise ArchiveError(f"the frame at byte {at} is cut short")
            frame = reader.decompressobj()
            try:
                record = frame.decompress(view[at:end])
            except zstandard.ZstdError as e:
                raise ArchiveError(f"frame at byte {at}: {e}") from e
            if not frame.eof or frame.unused_data:
                raise ArchiveError(f"the frame at byte {at} does not end where its blocks do")
            yield record
            at = end

    return dictionary, records()


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; raises ArchiveError where version, lengths or digest do not hold."""
    head, found, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ArchiveError(f"no header: {line!r}")
        fields[name.strip()] = value.strip()
    if missing := {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} - fields.keys():
        raise ArchiveError(f"without {sorted(missing)}")
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError("Content-Length does not match the block")
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/"):
        raise ArchiveError("no HTTP header")
    if fields["WARC-Type"] == "response" and (f"sha1:{digest_of(payload)}" != fields["WARC-Payload-Digest"] or str(len(payload)) != fields["X-Payload-Length"]):
        raise ArchiveError("the payload is not that of the header")
    if fields["WARC-Type"] == "revisit" and (payload or "WARC-Refers-To" not in fields):
        raise ArchiveError("a revisit with a payload or without what it refers to")
    return fields, payload


def _page(uri: str | None) -> int | None:
    return None if uri is None or uri == "<urn:page:none>" else int(uri.removeprefix("<urn:page:").removesuffix(">"))


def build_archives(pages: DataFrame, min_revisit: int = 0, dictionary: bytes | None = None) -> DataFrame:
    """(archive, content) of all pages.  Digests are found in the scan; only payloads that repeat are joined."""
    dictionary = train_dictionary(pages) if dictionary is None else dictionary
    shared = pages.sparkSession.sparkContext.broadcast(dictionary)  # DICT_BYTES at most
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    keys = rows.filter(F.octet_length("html") >= min_revisit).select("page_id", "digest")
    again = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    known = keys.distinct().join(again, "digest").select(F.coalesce("page_id", F.lit(NO_ID)).alias("key"), "digest", "first")
    joined = rows.withColumn("key", F.coalesce("page_id", F.lit(NO_ID))).join(known, ["key", "digest"], "left")
    # of rows with the first's id and payload one is the response; they are dealt alike already
    nth = F.row_number().over(Window.partitionBy("key", "digest").orderBy("key"))
    revisit = F.col("first").isNotNull() & ((F.col("key") != F.col("first")) | (nth > 1))
    joined = joined.select("page_id", "url", "html", "first", revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        kind = zstandard.ZstdCompressionDict(head) if head else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_checksum=True)
        parts, size = [dictionary_frame(head)], 0

        def close() -> pa.RecordBatch:
            content = b"".join(parts)
            return pa.RecordBatch.from_arrays([pa.array([f"{zlib.crc32(content):08x}-{len(content)}"]), pa.array([content], pa.binary())], ["archive", "content"])

        for batch in batches:
            for page, url, html, first, revisit in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                parts.append(press.compress(record_bytes(page, url, html.encode(), revisit, first if revisit else None)))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    parts, size = parts[:1], 0
        if size:
            yield close()

    return joined.mapInArrow(write, "archive string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of archives with a ``content`` column; an archive that isn't valid fails the query."""

    def rows(got: list[dict[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([_page(f["WARC-Record-ID"]) for f in got], pa.int64()), pa.array([int(f["X-Payload-Length"]) for f in got], pa.int64()),
                pa.array([f["WARC-Payload-Digest"].removeprefix("sha1:") for f in got]), pa.array([f["WARC-Type"] for f in got]),
                pa.array([_page(f.get("WARC-Refers-To")) for f in got], pa.int64()), pa.array([f["WARC-Target-URI"] for f in got]),
            ],
            ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"],
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                got = []
                for record in split_archive(content.as_py())[1]:
                    got.append(parse_record(record)[0])
                    if len(got) == ROWS:
                        yield rows(got)
                        got = []
                if got:
                    yield rows(got)

    return archives.select("content").mapInArrow(read, OUT)


def export_archives(archives: DataFrame, folder: str) -> None:
    """Write each archive as a .warc.zst file into ``folder``, a URI of a store (or an absolute path) that all executors reach."""

    def write(rows: Iterator) -> None:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        for row in rows:
            with store.open_output_stream(posixpath.join(path, f"{row.archive}.warc.zst"), compression=None) as f:
                f.write(row.content)

    archives.select("archive", "content").foreachPartition(write)


def round_trip(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Write the archives as a table of the shared folder, then read and validate them."""
    return read_archives(save(build_archives(pages, min_revisit)))
