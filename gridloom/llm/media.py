"""Media columns: payloads in archive files, read by a Spark data source that plans byte ranges.

write_archives() stores each payload losslessly as an 8-bit grey PNG image and packs images into zip archives in a shared
folder, each task its own archives, renamed when whole so that a repeated task replaces them. The data source
``media_archives`` lists the archives and plans byte ranges from their sizes alone. A task reads the archive's own
directory, takes the members whose headers start in its range, and reads each at its offset; a member that fails is
opened and read again by itself, and after the last try becomes a row with its error; so is the directory, without which
the task fails. Images leave in Arrow batches.

Defined cases: a null text is an empty payload, padded like any other; a null doc_id stays null; equal rows are members
of their own; a very long text is one member, held whole by its task as payload and image; an empty table gives an empty
folder and no rows. Other columns, also those named like results, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WIDTH = 576
_PNG = b"\x89PNG\r\n\x1a\n"
FIELDS = "archive string, member string, offset long, media binary, error string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    """Bytes 255 follow up to a positive multiple of WIDTH. UTF-8 never has that byte, so the length can be read back."""
    return data + b"\xff" * (max(1, -(-len(data) // WIDTH)) * WIDTH - len(data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with its filter: none
    lines[:, 1:] = rows
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    if media[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, packed = 8, b""
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        if zlib.crc32(media[at + 4 : at + 8 + n]) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"damaged chunk at {at}")
        packed += media[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()


class _Archive:
    def __init__(self, folder: str, name: str) -> None:
        self.fs, at = fs.FileSystem.from_uri(folder)
        self.path, self.part = f"{at}/{name}", f"{at}/_{name}.{TaskContext.get().taskAttemptId()}"
        self.out = self.fs.open_output_stream(self.part)
        self.zip, self.members, self.bytes = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED), 0, 0

    def add(self, name: str, media: bytes) -> None:
        self.zip.writestr(zipfile.ZipInfo(name), media)
        self.members += 1
        self.bytes += len(media)

    def close(self) -> tuple[str, int, int]:
        self.zip.close()
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.path, self.members, self.bytes


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes (doc_id, text) when the returned (archive, members, bytes) are computed. Members are named doc_id/partition-row.png."""
    uri, at = fs.FileSystem.from_uri(folder)
    uri.create_dir(at, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, archive, done, row = TaskContext.get().partitionId(), None, [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if archive is None:
                    archive = _Archive(folder, f"part-{part:06d}-{len(done):04d}.zip")
                archive.add(f"{'null' if doc is None else doc}/{part}-{row}.png", to_png(pad(text.as_buffer().to_pybytes() if text.is_valid else b"")))
                row += 1
                if archive.bytes >= archive_bytes or archive.members >= 60_000:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["archive", "members", "bytes"])

    return docs.select("doc_id", "text").mapInArrow(write, "archive string, members long, bytes long")


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.step = int(options.get("rangeBytes", 16 << 20))
        self.tries = int(options.get("tries", 3))

    def partitions(self) -> list[ByteRange]:
        store, at = fs.FileSystem.from_uri(self.folder)
        files = sorted((x.path, x.size) for x in store.get_file_info(fs.FileSelector(at)) if x.base_name.endswith(".zip") and not x.base_name.startswith("_"))
        return [ByteRange(path, i, min(i + self.step, size)) for path, size in files for i in range(0, size, self.step)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        file, rows, held = None, [], 0
        listed, error = self._tried(lambda: list(members(store.open_input_file(partition.path))))
        if listed is None:
            raise OSError(f"{partition.path}: {error}")
        for name, offset, size in listed:
            if not partition.start <= offset < partition.end:
                continue

            def get(offset: int = offset, size: int = size) -> bytes:
                nonlocal file
                try:
                    file = file or store.open_input_file(partition.path)
                    return member_at(file, offset, size)
                except (OSError, ValueError, struct.error):
                    file = None  # the next try opens it again
                    raise

            media, error = self._tried(get)
            rows.append((partition.path, name, offset, media, error))
            held += size
            if held > 4 << 20:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _tried(self, get: Callable[[], object]) -> tuple[object, str | None]:
        """What get gives, or None and the error of the last of so many tries."""
        error = None
        for _ in range(self.tries):
            try:
                return get(), None
            except (OSError, ValueError, struct.error) as e:
                error = str(e)
        return None, error

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FIELDS.split(", ")])


def members(file: pa.NativeFile) -> Iterator[tuple[str, int, int]]:
    """Name, header's offset and size of each member, from the directory at the archive's end."""
    size = file.size()
    file.seek(max(0, size - 65_557))
    tail = file.read()
    if (at := tail.rfind(b"PK\x05\x06")) < 0:
        raise ValueError("the archive has no directory")
    n, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    file.seek(start)
    listing, at = file.read(length), 0
    for _ in range(n):
        packed, named, extra, comment = (*struct.unpack("<I", listing[at + 20 : at + 24]), *struct.unpack("<HHH", listing[at + 28 : at + 34]))
        yield listing[at + 46 : at + 46 + named].decode(), struct.unpack("<I", listing[at + 42 : at + 46])[0], packed
        at += 46 + named + extra + comment


def member_at(file: pa.NativeFile, offset: int, size: int) -> bytes:
    file.seek(offset)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"no member starts at {offset}")
    file.seek(offset + 30 + sum(struct.unpack("<HH", head[26:30])))
    if len(media := file.read(size)) < size:
        raise ValueError(f"the member at {offset} is cut short")
    return media


class MediaArchives(DataSource):
    """Options: path (the folder of archives), rangeBytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema: object) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    """archive, member, offset, media, error."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(folder)


def features(samples: np.ndarray) -> str:
    """Mean, deviation, mean step between neighbours, and shares of eight bands of the samples."""
    x = samples.astype(np.float64)
    bands = np.bincount(samples >> 5, minlength=8) / len(x)
    return ",".join(f"{v:.6f}" for v in (x.mean(), x.std(), np.abs(np.diff(x)).mean(), *bands))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, media, error in zip(batch.column("member").to_pylist(), batch.column("media").to_pylist(), batch.column("error").to_pylist(), strict=True):
            if error is not None:
                raise ValueError(f"{name}: {error}")
            payload = from_png(media)
            doc = name.split("/")[0]
            rows.append((None if doc == "null" else int(doc), len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(np.frombuffer(payload, np.uint8))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if n in (3, 6, 7) else pa.int64()) for n, x in enumerate(zip(*rows, strict=True))], [x.split()[0] for x in DIGESTS.split(", ")])


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(archives: DataFrame) -> DataFrame:
    """One row for each member, from the payload that its stored bytes decode to. A member that stayed unreadable fails the job."""
    return archives.select("member", "media", "error").mapInArrow(_digest, DIGESTS)


def store_and_read(docs: DataFrame, folder: str) -> DataFrame:
    write_archives(docs, folder).agg(F.sum("members"), F.sum("bytes")).collect()
    return read_archives(docs.sparkSession, folder)
