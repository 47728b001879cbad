"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each holding the records of a few pages, and a last
skippable frame with the seek table (compressed and plain size of each frame, then a footer). The index
maps each record to its bundle, frame and place in the frame, so one record is read by decompressing one
frame. Any Zstandard reader can still read the whole bundle front to back.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import joined_in_parts, new_folder, saved

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
FRAMES_PER_TASK = 32
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the seekable format
INDEX = "page_id long, bundle string, frame int, at long, size long"


def digest_text(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit without a payload that names the record it repeats."""
    uid = lambda x: f"<urn:page:{x}>"
    one_line = " ".join((url or "").split())
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", uid(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", one_line),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        head += [("WARC-Refers-To", uid(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if refers_to is None else b"")
    head.append(("Content-Length", str(len(body))))
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + body + b"\r\n\r\n"


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], dict[str, str], bytes, int]:
    """WARC headers, HTTP headers, payload and the place after the record at `at`."""
    end = raw.index(b"\r\n\r\n", at)
    lines = raw[at:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    start, size = end + 4, int(head["Content-Length"])
    body = raw[start : start + size]
    cut = body.index(b"\r\n\r\n")
    http = dict(x.split(": ", 1) for x in body[:cut].decode().split("\r\n")[1:])
    return head, http, body[cut + 4 :], start + size + 4


class BundleWriter:
    """Writes frames to an open file and the seek table at the end."""

    def __init__(self, file, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.file, self.frame_bytes = file, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.parts: list[bytes] = []
        self.plain = self.written = 0
        self.table: list[tuple[int, int]] = []

    def add(self, raw: bytes) -> tuple[int, int]:
        """Frame and place in the frame of a record."""
        if self.parts and self.plain + len(raw) > self.frame_bytes:
            self.flush()
        place = len(self.table), self.plain
        self.parts.append(raw)
        self.plain += len(raw)
        return place

    def flush(self) -> None:
        if self.parts:
            packed = self.zstd.compress(b"".join(self.parts))
            self.file.write(packed)
            self.table.append((len(packed), self.plain))
            self.written += len(packed)
            self.parts, self.plain = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.file.close()


class BundleReader:
    """Frames of a bundle by number, through its seek table."""

    def __init__(self, file):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        size = file.size()
        file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("not a seekable bundle")
        file.seek(size - 9 - 8 * n)
        raw, at = file.read(8 * n), 0
        self.frames = []
        for packed, plain in struct.iter_unpack("<II", raw):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        self.file.seek(at)
        return self.zstd.decompress(self.file.read(packed), max_output_size=plain)

    def record(self, k: int, at: int) -> tuple[dict[str, str], dict[str, str], bytes]:
        return parse(self.frame(k), at)[:3]


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, least_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row of pages into bundles below `folder`, and return the saved index:
    page_id, bundle, frame, at, size.

    Of rows with one payload of at least `least_revisit_bytes` bytes, that with the largest id is the
    response and the others revisit it. Null html is an empty payload, a null URL an empty one. A null id
    never stands for others. Rows that repeat one id with one payload are responses all, as a record
    cannot revisit itself. Each task attempt writes bundles of its own name, and only those of attempts
    that succeed are in the index, so a lost executor or a speculative copy leaves no double records.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("bytes"))
    # narrow rows only: one per distinct payload after partial aggregation
    heads = rows.where(F.col("bytes") >= least_revisit_bytes).groupBy("sha1").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    # copies of one payload, however many, meet their head in parts
    joined = joined_in_parts(rows, heads, "sha1", "page_id", how="left").select("page_id", "url", "html", F.when(F.col("head") != F.col("page_id"), F.col("head")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _fs(folder)
        writer, name = None, ""
        for batch in batches:
            out: list[tuple] = []
            for page_id, url, text, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(system.open_output_stream(f"{top}/{name}", compression=None))
                payload = text.encode()
                raw = record(page_id, url, payload, digest_text(payload), refers_to, date)
                frame, at = writer.add(raw)
                out.append((page_id, f"{folder}/{name}", frame, at, len(raw)))
                if writer.written >= BUNDLE_BYTES:
                    writer.close()
                    writer = None
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "bundle", "frame", "at", "size"])
        if writer is not None:
            writer.close()

    return saved(_in_folder(joined, folder).mapInArrow(write, INDEX), "warc-index")


def _in_folder(df: DataFrame, folder: str) -> DataFrame:
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).mkdirs(path)
    return df


def read_archives(index: DataFrame) -> DataFrame:
    """Records of the index: page_id, record_type, url, payload (null in a revisit), payload_bytes,
    payload_digest, refers_to. Each frame is decompressed once, in the task that holds its rows."""

    def load(batches):
        for batch in batches:
            out, readers = [], {}
            for _, bundle, frame, ats in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if bundle not in readers:
                    system, path = _fs(bundle)
                    readers = {bundle: BundleReader(system.open_input_file(path))}
                raw = readers[bundle].frame(frame)
                for at in ats:
                    head, http, payload, _ = parse(raw, at)
                    number = lambda x: None if x == "None" else int(x)
                    of = lambda k: number(head[k].removeprefix("<urn:page:").removesuffix(">"))  # noqa: B023, E731
                    revisit = head["WARC-Type"] == "revisit"
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and digest_text(payload) != digest:
                        raise ValueError(f"record {head['WARC-Record-ID']} does not fit its digest")
                    out.append((of("WARC-Record-ID"), head["WARC-Type"], head["WARC-Target-URI"], None if revisit else payload, int(http["Content-Length"]), digest, of("WARC-Refers-To") if revisit else None))
                if len(out) >= 500:
                    yield _records(out)
                    out = []
            yield _records(out)

    places = saved(index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("at")).alias("at")).withColumn("k", F.xxhash64("bundle", "frame")), "warc-frames")
    # rows are a few bytes but stand for a frame each, so tasks are sized by frames
    # sorted, so that a task opens a bundle and reads its seek table once
    places = places.repartition(max(1, -(-places.count() // FRAMES_PER_TASK)), "k").sortWithinPartitions("bundle", "frame")
    return places.select("k", "bundle", "frame", "at").mapInArrow(load, "page_id long, record_type string, url string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def _records(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
    columns = list(zip(*out, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "record_type", "url", "payload", "payload_bytes", "payload_digest", "refers_to"])


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write pages to bundles in a new shared folder and read their records back: one row per row of pages.

    Null html is an empty payload, a null url an empty target, and a null id is written as None, is always a
    response and nothing refers to it. Rows that repeat an id and payload are records each, all responses if the
    id is the largest. An empty table gives no bundle and no rows; further columns are ignored.
    """
    return read_archives(write_archives(pages, new_folder(pages.sparkSession, "warc"), **options))
