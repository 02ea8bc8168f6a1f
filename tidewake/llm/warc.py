"""WARC archives as seekable Zstandard bundles.

A bundle is a ``.warc.zst`` file: independent Zstandard frames that each hold a group of WARC
records, then a skippable frame with the seek table of the Zstandard seekable format (compressed and
decompressed size of each frame, and a footer). The manifest maps record ids to bundle, frame and the
record's offset inside the decompressed frame, so that one record costs one seek and one frame.

Every executor writes files of its own, under names that no other attempt uses, and moves each into
place when it is complete. Only files named in the manifest count; those of lost or repeated
attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import fresh_path, written

# Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

MANIFEST = "bundle string, frame long, frame_at long, frame_bytes long, offset long, length long, page_id long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(record_id: str) -> int | None:
    text = record_id[len("<urn:page:") : -1]
    return int(text) if text else None


def _header_text(value: str | None) -> str:
    """A value as one header line: controls are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_header_text(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at ``at`` and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"damaged record {head['WARC-Record-ID']}")
    refers = head.get("WARC-Refers-To")
    return {
        "page_id": _page_of(head["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": head["WARC-Type"],
        "refers_to": _page_of(refers) if refers else None, "url": head["WARC-Target-URI"], "payload": payload if head["WARC-Type"] == "response" else None,
    }, end + 4 + len(block) + 4


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class BundleWriter:
    """Collects records into frames and frames into one seekable bundle."""

    def __init__(self, path: str, frame_bytes: int, level: int):
        self.fs, self.path = _filesystem(path)
        self.temporary = f"{self.path}.part"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.uri, self.most, self.at, self.table, self.frame, self.held, self.rows = path, frame_bytes, 0, [], [], 0, []

    def add(self, page_id: int | None, record: bytes) -> None:
        if self.held and self.held + len(record) > self.most:
            self._end_frame()
        self.rows.append([self.uri, len(self.table), self.at, None, self.held, len(record), page_id])
        self.frame.append(record)
        self.held += len(record)

    def _end_frame(self) -> None:
        packed = self.packer.compress(b"".join(self.frame))
        self.out.write(packed)
        for row in reversed(self.rows):
            if row[3] is not None:
                break
            row[3] = len(packed)
        self.table.append((len(packed), self.held))
        self.at, self.frame, self.held = self.at + len(packed), [], 0

    def close(self) -> pd.DataFrame:
        if self.frame:
            self._end_frame()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        self.out.close()
        self.fs.move(self.temporary, self.path)
        out = pd.DataFrame(self.rows, columns=[x.split()[0] for x in MANIFEST.split(", ")])
        out["page_id"] = out["page_id"].astype("Int64")
        return out


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(position, compressed size, decompressed size) of each frame, from the footer of a bundle."""
    size = file.size()
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table at the end of the bundle")
    file.seek(size - 9 - 8 * n)
    at, out = 0, []
    for packed, plain in struct.iter_unpack("<II", file.read(8 * n)):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(file, frame: int, table: list[tuple[int, int, int]]) -> bytes:
    at, packed, plain = table[frame]
    file.seek(at)
    return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds digest, size and the page that a revisit refers to.

    Of the records whose payloads are equal and have ``min_bytes`` bytes at least, the largest
    page_id is the response and the others revisit it; smaller payloads are responses all. The
    groups are made from (digest, size, page_id) alone and combined before the shuffle; the join's
    left side can be split by adaptive execution where one payload holds a large share of the rows.
    """
    body = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"sha": F.sha1("payload"), "size": F.length("payload").cast("long")})
    first = body.groupBy("sha", "size").agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).filter(F.col("n") > 1).filter(F.col("size") >= min_bytes)
    revisit = F.col("last_id").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last_id")))
    return body.join(first.drop("n"), ["sha", "size"], "left").withColumn("refers_to", F.when(revisit, F.col("last_id"))).select("page_id", "url", "payload", "sha", "refers_to", revisit.alias("revisit"))


def write_archives(pages: DataFrame, path: str | None = None, *, min_bytes: int = 0, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as WARC bundles and returns the manifest.

    Null html is an empty payload, a null url an empty target, a null page_id the id
    ``<urn:page:>`` (never a response that others refer to, unless the whole group has null ids:
    then all are responses). Repeated rows are records of their own; rows that share the largest
    page_id of a group are all responses. Columns besides the three are ignored, whatever their
    names. A page of any length is one record in a frame of its own if it is over ``frame_bytes``.
    An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    root = (path or fresh_path(spark, "warc")).rstrip("/")
    bundles = f"{root}/bundles"

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, held = None, 0
        for part in parts:
            ids, refers = part["page_id"].astype("Int64"), part["refers_to"].astype("Int64")
            for page_id, url, payload, sha, to, revisit in zip(ids, part["url"], part["payload"], part["sha"], refers, part["revisit"]):
                if writer is None:
                    fs, folder = _filesystem(bundles)
                    fs.create_dir(folder, recursive=True)
                    writer, held = BundleWriter(f"{bundles}/{uuid.uuid4().hex}.warc.zst", frame_bytes, level), 0
                page_id, to, payload = None if pd.isna(page_id) else int(page_id), None if pd.isna(to) else int(to), bytes(payload)
                record = encode_record(page_id, url if isinstance(url, str) else None, payload, base64.b32encode(bytes.fromhex(sha)).decode(), to, bool(revisit), date)
                writer.add(page_id, record)
                held += len(record)
                if held >= bundle_bytes:
                    yield writer.close()
                    writer = None
        if writer is not None:
            yield writer.close()

    return written(with_revisits(pages, min_bytes).mapInPandas(write, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, task_bytes: int = 4 << 20) -> DataFrame:
    """All records of the bundles in ``manifest``, each found by its offset in its frame.

    Frames are dealt out to one task for each ``task_bytes`` of their compressed bytes.
    """
    frames = manifest.groupBy("bundle", "frame").agg(F.max("frame_bytes").alias("bytes"), F.sort_array(F.collect_list("offset")).alias("offsets"))  # of one frame
    total = frames.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first().n
    return _read(frames.repartition(max(1, -(-total // task_bytes)), "bundle", "frame"))


def read_records(manifest: DataFrame, page_ids: DataFrame, task_bytes: int = 4 << 20) -> DataFrame:
    """The records of the pages in ``page_ids`` (page_id), each by one seek to its frame and its offset there.

    A null id finds the records without an id. Repeated ids count once; ids that aren't in the
    manifest give nothing.
    """
    wanted = page_ids.select("page_id").distinct()
    picked = manifest.join(wanted.withColumnRenamed("page_id", "_wanted"), F.col("page_id").eqNullSafe(F.col("_wanted")), "left_semi")
    return read_archives(picked, task_bytes)


def _read(frames: DataFrame) -> DataFrame:
    """The records at ``offsets`` of each of ``frames`` (bundle, frame, offsets)."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for bundle, rows in part.groupby("bundle"):
                fs, path = _filesystem(bundle)
                with fs.open_input_file(path) as file:
                    table = read_seek_table(file)
                    for frame, offsets in zip(rows["frame"], rows["offsets"]):
                        data = read_frame(file, frame, table)
                        out = pd.DataFrame([decode_record(data, int(at))[0] for at in offsets])
                        yield out.assign(page_id=out["page_id"].astype("Int64"), refers_to=out["refers_to"].astype("Int64"))

    return frames.select("bundle", "frame", "offsets").mapInPandas(read, RECORDS)
