"""WARC archives in seekable Zstandard: records in frames, a seek table at the end.

Each task writes one archive of the rows it holds.  Some records share a frame; the
frames are independent, and a skippable frame at the end lists their sizes, as the
seekable format of Zstandard lays down.  The index, a table, says for each record
in which frame it begins and where in the frame.  Files get a new name in every
attempt, and only those of attempts that ended well are in the index.

Records of equal payload are found by digest before anything is written: that of
the smallest id is a response, the others revisit it and carry no payload.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from textveil.llm.frames import stored, with_group_values
from textveil.sources.workspace import new_dir

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1  # fixed values of the format
FRAME = 1 << 18
LEAST = 100
TASK_BYTES = 16 << 20  # packed bytes that one task reads

RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
INDEX = "page_id bigint, file string, frame_at bigint, frame_size bigint, record_at bigint, record_size bigint"


def file_system(uri: str):
    """A file system and the path in it; any that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit has the payload's digest and length but not the payload."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    url = "".join(x for x in url if x.isprintable())
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends an archive: sizes of each frame, packed and not."""
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """Place, packed and unpacked size of each frame of an open archive."""
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    raw, at, out = f.read(8 * n), 0, []
    for packed, plain in struct.iter_unpack("<II", raw):
        out.append((at, packed, plain))
        at += packed
    return out


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST, frame: int = FRAME, date: str | None = None) -> DataFrame:
    """Write all pages and return the index of the records, itself a table on disk.

    ``pages``: page_id, url, html.  Null html is empty, null urls too.  Among rows of
    equal payload of at least ``least`` bytes the smallest id is the response; rows
    that repeat its id and payload are responses as well; rows of null id revisit
    it, and are responses where no row has an id.  An empty table gives an empty
    index.  Other columns are not looked at.  ``date`` (ISO 8601, UTC) is that of all
    records, the time of the call if left out.
    """
    import zstandard

    spark = pages.sparkSession
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ") if date is None else date
    folder = new_dir(spark, "archives") if folder is None else folder
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest")
    )
    narrow = stored(rows.where(F.octet_length("html") >= least).select("page_id", "digest"), "digests")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("to"), F.count("*").alias("n")).where("n > 1 and to is not null")
    again = with_group_values(narrow, first, ["digest"], "n", narrow.count())
    again = again.where("to is not null and not (page_id <=> to)").select(F.col("page_id").alias("_id"), F.col("digest").alias("_d"), "to").distinct()
    known = rows.join(again, rows["page_id"].eqNullSafe(again["_id"]) & (rows["digest"] == again["_d"]), "left")
    known = known.select("page_id", "url", "html", "digest", F.col("to").alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.zst"
        fs, base = file_system(folder)
        out = None
        sizes: list[tuple[int, int]] = []
        waiting: list[tuple] = []
        plain, at = bytearray(), 0

        def end_frame() -> Iterator[pa.RecordBatch]:
            nonlocal at, plain
            packed = packer.compress(bytes(plain))
            out.write(packed)
            sizes.append((len(packed), len(plain)))
            ids, begins, lengths = zip(*waiting)
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([name] * n), pa.array([at] * n, pa.int64()), pa.array([len(packed)] * n, pa.int64()), pa.array(begins, pa.int64()), pa.array(lengths, pa.int64())],
                ["page_id", "file", "frame_at", "frame_size", "record_at", "record_size"],
            )
            at += len(packed)
            waiting.clear()
            plain = bytearray()

        for batch in batches:
            for page_id, url, text, digest, to in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                raw = record(page_id.as_py(), url.as_py(), text.as_py().encode(), digest.as_py(), to.as_py(), date)
                waiting.append((page_id.as_py(), len(plain), len(raw)))
                plain += raw
                if len(plain) >= frame:
                    yield from end_frame()
        if out is not None:
            if waiting:
                yield from end_frame()
            out.write(seek_table(sizes))
            out.close()

    return stored(known.mapInArrow(run, INDEX).withColumn("folder", F.lit(folder)), "index")


def read_archives(index: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """All records of an index, read by seeking to their frames.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to.  What a
    response states is checked against its payload.  Frames are dealt to tasks of
    some ``task_bytes`` packed bytes.
    """
    frames = index.groupBy("folder", "file", "frame_at", "frame_size").agg(F.collect_list(F.struct("record_at", "record_size")).alias("records"))
    total = frames.agg(F.coalesce(F.sum("frame_size"), F.lit(0))).first()[0]
    frames = frames.repartition(max(1, -(-total // task_bytes)), "folder", "file", "frame_at")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                fs, base = file_system(row["folder"])
                with fs.open_input_file(f"{base}/{row['file']}") as f:
                    f.seek(row["frame_at"])
                    plain = unpacker.decompress(f.read(row["frame_size"]))
                yield _described([parse(plain[r["record_at"] : r["record_at"] + r["record_size"]]) for r in row["records"]], row["file"])

    return frames.mapInArrow(run, RECORDS)


def read_whole_archives(index: DataFrame) -> DataFrame:
    """The same records without the index's places: each archive by the seek table at its end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for folder, file in zip(batch.column("folder").to_pylist(), batch.column("file").to_pylist()):
                fs, base = file_system(folder)
                with fs.open_input_file(f"{base}/{file}") as f:
                    for at, packed, _ in read_seek_table(f, f.size()):
                        f.seek(at)
                        yield _described(list(records_of(unpacker.decompress(f.read(packed)))), file)

    files = index.select("folder", "file").distinct()
    return files.repartition(max(1, files.count()), "folder", "file").mapInArrow(run, RECORDS)


def records_of(plain: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and body of each record of a frame."""
    at = 0
    while at < len(plain):
        fields, body = parse(plain[at:])
        yield fields, body
        at = plain.index(b"\r\n\r\n", at) + 4 + len(body) + 4


def _described(records: list[tuple[dict[str, str], bytes]], file: str) -> pa.RecordBatch:
    def number(x: str) -> int | None:
        return int(y) if (y := x.removeprefix("<urn:page:").rstrip(">")) else None

    out = []
    for fields, body in records:
        size, digest = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
        if fields["WARC-Type"] == "response" and (len(body), hashlib.sha256(body).hexdigest()) != (size, digest):
            raise ValueError(f"damaged record in {file}")
        to = fields.get("WARC-Refers-To")
        out.append((number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], None if to is None else number(to)))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
