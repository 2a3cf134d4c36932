"""Media columns: texts as 8-bit grey PNG images in ZIP archives, read back through a custom data source.

Writing packs each row's payload (UTF-8 bytes, zero bytes up to a positive multiple of 64) losslessly into an image 64
samples wide and appends the images, stored as they are, to archives of bounded size. An archive gets its name when
it is whole, so a lost executor leaves none behind.

Reading is a Python data source. It plans byte ranges over the archives of a folder: a member belongs to the range
that its local header starts in, as the archive's own directory says, so ranges of one archive are read by different
tasks. Members go out as Arrow batches of bounded size. Each is fetched by its offset, checked against the
directory's CRC-32, and fetched again by that offset on a freshly opened archive if that fails; others are not.

Defined results: null text counts as empty, and an empty text is 64 zero bytes; equal texts give equal images; repeated
rows and null doc_ids are members like any other; an empty table gives no rows; only the id and text columns are
read. A member that stays damaged after all tries raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import by_bytes, give_back, open_store, settle, shared_folder, utf8

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def to_png(data: bytes) -> bytes:
    """An image of data's payload; a text chunk keeps the length without padding."""
    rows = np.frombuffer(payload(data), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line starts with filter 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> tuple[bytes, int]:
    """The payload of an image and its length without padding; ValueError for other or damaged images."""
    if image[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, parts = 8, {}
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        data = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError("a chunk of an image is damaged")
        parts[kind] = parts.get(kind, b"") + data
        at += 12 + size
    width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("only unfiltered 8-bit grey images are read")
    return lines[:, 1:].tobytes(), int(parts[b"tEXt"].partition(b"\0")[2])


def features(samples: bytes) -> str:
    """Size, mean, deviation and entropy of an image's samples, and which of its 16 bands are lighter than the mean."""
    raw = np.frombuffer(samples, np.uint8)
    seen = np.bincount(raw, minlength=256)
    share = seen[seen > 0] / len(raw)
    value = np.arange(256)
    mean = float((seen * value).sum() / len(raw))
    deviation = float(np.sqrt((seen * (value - mean) ** 2).sum() / len(raw)))
    bands = [float(x.mean()) for x in np.array_split(raw, 16)]
    return f"{WIDTH}x{len(raw) // WIDTH} mean={mean:.3f} dev={deviation:.3f} bits={-(share * np.log2(share)).sum():.3f} bands={sum((x > mean) << i for i, x in enumerate(bands)):04x}"


def write_archives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, archive_bytes: int = 32 << 20) -> str:
    """Writes docs' images into archives of about archive_bytes; their folder."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "archives")
    fs, root = open_store(folder)
    fs.create_dir(root, recursive=True)

    def run(batches):
        fs, root = open_store(folder)
        task = TaskContext.get()
        number, members, size, out, archive = 0, 0, 0, None, None
        name = f"{root}/attempt-{task.taskAttemptId()}"

        def finish():
            archive.close()
            out.close()
            settle(fs, name, f"{root}/part-{task.partitionId():06d}-{number:05d}.zip")

        for batch in (x for b in batches for x in by_bytes(b, 1)):
            for doc, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if archive is None:
                    out = fs.open_output_stream(name)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                image = to_png(data)
                archive.writestr(zipfile.ZipInfo(f"{members:07d}_{'null' if doc is None else doc}.png"), image)
                members, size = members + 1, size + len(image)
                if size >= archive_bytes:
                    finish()
                    number, members, size, archive = number + 1, 0, 0, None
        if archive is not None:
            finish()
            number += 1
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], names=["archives"])

    docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "archives long").agg(F.sum("archives")).collect()
    return folder


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", 16 << 20))
        self.batch_bytes = int(options.get("batchbytes", 8 << 20))
        self.tries = int(options.get("tries", 3))

    def partitions(self) -> list[ByteRange]:
        fs, root = open_store(self.folder)
        found = sorted((x.path, x.size) for x in fs.get_file_info(pafs.FileSelector(root)) if x.path.endswith(".zip"))
        return [ByteRange(path, at, min(size, at + self.range_bytes)) for path, size in found for at in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange):
        if not partition.path:
            return
        fs, _ = open_store(self.folder)
        with fs.open_input_file(partition.path) as f:
            own = sorted((x.header_offset, x.compress_size, x.CRC, x.filename) for x in zipfile.ZipFile(f).infolist() if partition.start <= x.header_offset < partition.end)
        f = fs.open_input_file(partition.path)
        out, size = [], 0
        for offset, n, crc, name in own:
            for left in reversed(range(self.tries)):
                try:
                    media = member(f, offset, n, crc)
                    break
                except (OSError, ValueError, struct.error):
                    if not left:
                        raise
                    f.close()
                    f = fs.open_input_file(partition.path)
            doc = name.partition("_")[2].removesuffix(".png")
            out.append((None if doc == "null" else int(doc), name, media))
            size += n
            if size >= self.batch_bytes:
                yield _batch(out)
                out, size = [], 0
        f.close()
        if out:
            yield _batch(out)


def member(f, offset: int, size: int, crc: int) -> bytes:
    """The stored bytes of the member whose local header is at offset."""
    f.seek(offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member starts here")
    f.seek(offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
    data = f.read(size)
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("a member is damaged")
    return data


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, names, media = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(media, pa.binary())], names=["doc_id", "member", "media"])


class ArchiveSource(DataSource):
    """format("media_archive"): options path, rangeBytes, batchBytes, tries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, member string, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """doc_id, member, media of each image in a folder's archives."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(path=folder, **options).load()


def described(images: DataFrame) -> DataFrame:
    """Digests and features of images that were read."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for media in batch.column(1).to_pylist():
                data, n = from_png(media)
                for column, x in zip(out, (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(data)), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kind) for x, kind in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return images.select("doc_id", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores docs' texts as images, reads them back and describes them."""
    return described(read_archives(docs.sparkSession, write_archives(docs, id_col, text_col)))
