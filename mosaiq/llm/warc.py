"""WARC archives as seekable Zstandard bundles.

A bundle is one file: records grouped into independent Zstandard frames, then a skippable frame with the seek table of
the published seekable format (compressed and decompressed size per frame). A record map gives for each record id its
bundle, frame and offset inside the frame, so one record costs one frame. Records whose payload equals that of another
record are stored as revisits without it.

Bundles are rows of a binary column, written by Spark's own committer: a lost task is run again and leaves no partial
file, and any store that Spark writes will do. `export` puts them out as .warc.zst files.

Only page ids, digests and lengths are shuffled to find equal payloads. The pages' html is then joined to their record
types by page, never by payload, so a payload that a third of all pages share stays spread.

Defined results: null html counts as empty, null url as an empty target; rows of one page id and one payload get the
same type; null page ids sort before all others; other columns are not read; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import parts, utf8, written

#: Raw bytes after which a frame, and compressed bytes after which a bundle, is closed.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 8 << 20
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2000-01-01T00:00:00Z"


def record(page_id: int | None, url: str, kind: str, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block. The id and date are functions of the row, so reruns agree."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        payload = b""
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of a decompressed frame, from an offset on."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        n = int(head["Content-Length"])
        yield at, head, data[end + 4 : end + 4 + n]
        at = end + 8 + n


class Bundle:
    """Collects records into frames; close() gives the file."""

    def __init__(self, level: int = 3):
        self.codec = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.raw = self.packed = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset inside it."""
        if self.raw and self.raw + len(data) > FRAME_BYTES:
            self.cut()
        spot = len(self.frames), self.raw
        self.open.append(data)
        self.raw += len(data)
        return spot

    def cut(self) -> None:
        if self.open:
            frame = self.codec.compress(b"".join(self.open))
            self.frames.append(frame)
            self.table.append((len(frame), self.raw))
            self.packed += len(frame)
            self.open, self.raw = [], 0

    def close(self) -> bytes:
        self.cut()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        foot = entries + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(foot)) + foot


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the footer."""
    n, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    out, at, base = [], 0, len(bundle) - 9 - n * width
    for k in range(n):
        packed, raw = struct.unpack_from("<II", bundle, base + k * width)
        out.append((at, packed, raw))
        at += packed
    return out


def read_frame(bundle: bytes, frame: int) -> bytes:
    at, packed, raw = seek_table(bundle)[frame]
    return zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=max(raw, 1))


def read_record(bundle: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """The record that the map places at (frame, offset); one frame is decompressed."""
    _, head, block = next(parse(read_frame(bundle, frame), offset))
    return head, block


def revisited(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Distinct (page_id, digest) that are revisits, and the page that holds the payload as `last`."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= least_bytes)
    rows = written(rows.select("page_id", "digest").distinct(), "digests")
    last = rows.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("digest", "last")
    return rows.join(last, "digest").where("not (page_id <=> last)")


def bundles(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Bundles and their record map: bundle (string id), data (binary), records array of (page_id, frame, offset)."""
    pages = pages.select("page_id", "url", "html")
    revisits = revisited(pages, least_bytes).select(F.col("page_id").alias("of"), F.col("digest").alias("of_digest"), "last", F.lit(True).alias("again"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.withColumn("digest", F.sha1(payload))
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
    rows = rows.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), "digest", F.coalesce("again", F.lit(False)).alias("again"), "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, spots = Bundle(), []

        def closed() -> pa.RecordBatch:
            data = bundle.close()
            name = hashlib.sha1(data).hexdigest()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary()), pa.array([[{"page_id": p, "frame": f, "offset": o} for p, f, o in spots]], pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64())])))], names=["bundle", "data", "records"])

        for batch in parts(batches):
            ids, urls, digests, agains, lasts = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            for p, url, html, digest, again, last in zip(ids, urls, utf8(batch.column(2)), digests, agains, lasts, strict=True):
                spots.append((p, *bundle.add(record(p, url, "revisit" if again else "response", html, digest, len(html), last))))
                if bundle.packed >= BUNDLE_BYTES:
                    yield closed()
                    bundle, spots = Bundle(), []
        if spots:
            yield closed()

    return rows.mapInArrow(run, "bundle string, data binary, records array<struct<page_id:long, frame:int, offset:long>>")


def read_bundles(stored: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each stored record, found by the record map and the seek
    tables; each frame is decompressed once. A response's length and digest are taken from the payload that was read; a wrong
    digest, or another record than the map says, raises ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = zstandard.ZstdDecompressor()
        number = lambda x: int(x[10:-1]) if len(x) > 11 else None  # noqa: E731  <urn:page:7>
        for batch in batches:
            # One bundle at a time is taken out of the batch, whose bytes Spark bounds.
            for data, spots in ((x.as_py(), y.as_py()) for x, y in zip(batch.column(0), batch.column(1), strict=True)):
                frames = seek_table(data)
                for number_of_frame, found in groupby(spots, key=lambda x: x["frame"]):
                    at, packed, raw = frames[number_of_frame]
                    plain, rows = decoder.decompress(data[at : at + packed], max_output_size=max(raw, 1)), []
                    for spot in found:
                        _, head, block = next(parse(plain, spot["offset"]))
                        if number(head["WARC-Record-ID"]) != spot["page_id"]:
                            raise ValueError("the record map names another record")
                        size, digest = int(head["X-Payload-Length"]), head["WARC-Payload-Digest"][5:]
                        if head["WARC-Type"] == "response":
                            size = len(block)
                            if hashlib.sha1(block).hexdigest() != digest:
                                raise ValueError("a stored payload has another digest")
                        rows.append((number(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None))
                    cols = zip(*rows, strict=True)
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return written(stored.select("data", "records").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), "records")


def archive(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write all pages as bundles to the shared folder, then read the archives back."""
    return read_bundles(written(bundles(pages, least_bytes), "warc"))


def export(stored: DataFrame, folder_uri: str) -> DataFrame:
    """Put each bundle out as <bundle>.warc.zst under a folder that every executor reaches (a URI pyarrow knows). Each file is
    written under a temporary name and renamed, so a task that runs twice leaves one whole file. Returns bundle and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder_uri)
        store.create_dir(base, recursive=True)
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            for name, data in zip(names, (x.as_py() for x in batch.column(1)), strict=True):
                part = f"{base}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, f"{base}/{name}.warc.zst")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sizes, pa.int64())], names=["bundle", "size"])

    return written(stored.select("bundle", "data").mapInArrow(run, "bundle string, size long"), "exported")
