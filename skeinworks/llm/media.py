"""Media columns: payloads stored losslessly in archives, and a Spark data source that reads archive directories.

A payload becomes an 8-bit greyscale PNG image of 24 pixels' width (576 bytes to a 24 x 24 tile), with its
unpadded size in a text chunk. Tasks write images as stored members of ZIP archives under names of their own;
a list of the archives whose tasks succeeded is written last, so an attempt that was lost leaves
nothing that is read. The data source plans byte ranges over the archives: the driver reads only the fixed
record at an archive's end, and a reading task takes from the archive's directory the members that start in its range.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skeinworks.llm.words import trimmed
from skeinworks.plans.stage import bounded_batches, new_path

TILE, WIDTH, FILL = 576, 24, 255
LIST = "archives.json"
_PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(raw: bytes) -> bytes:
    """raw with bytes 255 up to a positive multiple of 576."""
    return raw + bytes([FILL]) * (max(TILE, -(-len(raw) // TILE) * TILE) - len(raw))


def to_png(raw: bytes) -> bytes:
    payload = padded(raw)
    lines = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # a filter byte of 0 before each line
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(raw)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded size) of an image that to_png made; ValueError if it is damaged."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, size, data, shape = 8, None, [], None
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            size = int(body[8:])
        elif kind == b"IDAT":
            data.append(body)
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    payload = lines[:, 1:].tobytes()
    return payload, len(payload) if size is None else size


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


# --- writing ------------------------------------------------------------------------------------------


def write_archives(docs: DataFrame, path: str | None = None, most: int = 1 << 28) -> str:
    """Store each row's text as an image member named by doc_id; the folder. most: bytes after which a task begins a new archive."""
    spark = docs.sparkSession
    path = path or new_path(spark, "media")
    fs, base = filesystem(path)
    fs.create_dir(base, recursive=True)

    def write(batches):
        fs, base = filesystem(path)
        done, out, name = [], None, ""

        def close():
            out[0].close()
            out[1].close()
            done.append(name)

        fs.create_dir(base, recursive=True)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                if out is None:
                    name = f"{uuid.uuid4().hex}.zip"
                    stream = fs.open_output_stream(f"{base}/{name}")
                    out = (zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED), stream)
                key, text = ids[i].as_py(), texts[i].as_py()
                out[0].writestr(zipfile.ZipInfo("null" if key is None else str(key)), to_png((text or "").encode()))
                if stream.tell() >= most:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["archive"])

    names = sorted(r["archive"] for r in docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(write), "archive string").collect())  # a name or two a task
    with fs.open_output_stream(f"{base}/{LIST}") as f:
        f.write(json.dumps(names).encode())
    return path


# --- reading ------------------------------------------------------------------------------------------


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.span = int(options.get("rangeBytes", 1 << 25))
        self.batch = int(options.get("batchBytes", 1 << 23))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[Range]:
        """Byte ranges of about rangeBytes over the archives of the folder's list; [] for none."""
        fs, base = filesystem(self.path)
        with fs.open_input_stream(f"{base}/{LIST}") as f:
            names = json.loads(f.read())
        sizes = [x.size for x in fs.get_file_info([f"{base}/{n}" for n in names])] if names else []
        out = [Range(n, a, min(a + self.span, size)) for n, size in zip(names, sizes, strict=True) for a in range(0, size, self.span)]
        return out or [Range("", 0, 0)]

    def _member(self, fs, name: str, at: int, size: int, crc: int) -> tuple[bytes | None, str | None]:
        """The member whose local header is at `at`; each attempt opens the archive anew, so one bad read costs no other member."""
        why = ""
        for k in range(self.attempts):
            try:
                with fs.open_input_file(name) as f:
                    f.seek(at)
                    return self._at(f, size, crc), None
            except (OSError, ValueError) as e:
                why = f"{type(e).__name__}: {e}"
                time.sleep(0.05 * 2**k)
        return None, why

    @staticmethod
    def _at(f, size: int, crc: int) -> bytes:
        head = f.read(30)
        if head[:4] != b"PK\3\4":
            raise ValueError("no member here")
        n, extra = struct.unpack("<HH", head[26:30])
        f.seek(n + extra, 1) if not isinstance(f, pa.NativeFile) else f.seek(f.tell() + n + extra)
        data = f.read(size)
        if len(data) != size or zlib.crc32(data) != crc:
            raise ValueError("damaged member")
        return data

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.archive:
            return
        fs, base = filesystem(self.path)
        name = f"{base}/{part.archive}"
        with fs.open_input_file(name) as f:
            members = [(x.header_offset, x.filename, x.file_size, x.CRC) for x in zipfile.ZipFile(f).infolist() if part.start <= x.header_offset < part.end]
        held, size = [], 0
        with fs.open_input_file(name) as f:
            for at, key, n, crc in sorted(members):
                try:
                    f.seek(at)
                    media, why = self._at(f, n, crc), None
                except (OSError, ValueError):
                    media, why = self._member(fs, name, at, n, crc)
                held.append((part.archive, at, key, media, why))
                size += n
                if size >= self.batch:
                    yield self._rows(held)
                    held, size = [], 0
        if held:
            yield self._rows(held)

    @staticmethod
    def _rows(held) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()), strict=True)], ["archive", "offset", "member", "media", "error"])


class ArchiveSource(DataSource):
    """format("archive_members"): archive, offset, member, media, error (null unless a member could not be read after all attempts)."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, offset long, member string, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive_members").option("path", path).load()


def features(payload: bytes) -> str:
    """Integer statistics of the samples: tiles, sum, sum of squares, sum of step sizes, and counts by the upper four bits."""
    v = np.frombuffer(payload, np.uint8)
    wide = v.astype(np.int64)
    bins = np.bincount(v >> 4, minlength=16)
    return f"tiles={len(v) // TILE};sum={wide.sum()};squares={(wide * wide).sum()};steps={np.abs(np.diff(wide)).sum()};bins={','.join(map(str, bins.tolist()))}"


def media_columns(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Store every text as media and compute columns from what is read back.

    docs: doc_id long (null is kept), text string (null: empty); other columns are ignored. Every row has a member
    of its own, repeated ids too. Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, error. A member that can't be read or decoded keeps its row, with nulls and the reason in error.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    members = read_archives(spark, write_archives(docs, path)).select("member", "media", "error")

    def columns(batches):
        for pdf in batches:
            rows = []
            for key, media, error in zip(pdf["member"], pdf["media"], pdf["error"], strict=True):
                row = [None if key == "null" else int(key), *[None] * 7, error]
                try:
                    if error is None:
                        payload, n = from_png(media)
                        row[1:8] = n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)
                except (ValueError, zlib.error) as e:
                    row[8] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), OUT.types, strict=True)], schema=OUT)

    def over(batches):
        return columns(b.to_pandas() for b in batches if b.num_rows)

    return members.mapInArrow(trimmed(over), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())])
