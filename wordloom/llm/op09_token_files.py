"""Token-id files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

All ids are counted over the corpus, while it is tokenized, and replaced by their rank, so frequent ids take one byte. Four ids share a
control byte of four 2-bit sizes; sizes and data lie in separate streams, and a reader finds each value's place by
looking the control bytes up in a table of 256 rows, with numpy and no loop over ids.

A file is a sequence of blocks of whole documents: a header of six little-endian 64-bit numbers (mark, documents,
ids, control bytes, data bytes, and the CRC-32 of all that follows), then the doc_ids, a validity byte for
each, the documents' sizes, the control bytes and the data. Files hold documents in ascending doc_id order, file
after file. A file is written under its attempt's name and renamed when it is whole, so lost executors leave no
half of one. The rank table stands beside the files.

Defined results: null text counts as empty; an empty text is its end id alone; null doc_ids come first; rows that
share a doc_id stand in the order of their number of ids, then of a hash of these; an empty table gives no rows; only the id and text columns
are read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, open_store, scratch, settle, shared_folder, stored
from .op07_packing import offsets, tokenized, unpacked

MARK = 0x31534449_4B4E5254
_SIZES = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)
_TOTALS = _SIZES.sum(axis=1).astype(np.int64)
BLOCK_IDS = 1 << 20


def pack_ids(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.asarray(values, np.uint32)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint32)
    padded[: len(values)] = values
    size = 1 + (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    control = ((size.reshape(-1, 4) - 1) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    raw = padded.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), raw[np.arange(4) < size[:, None]].tobytes()


def unpack_ids(control: bytes, data: bytes, n: int) -> np.ndarray:
    control = np.frombuffer(control, np.uint8)
    size = _SIZES[control].ravel()
    raw = np.zeros((len(size), 4), np.uint8)
    raw[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return raw.view("<u4").ravel()[:n]


def block(docs: list[int | None], ids: list[np.ndarray]) -> bytes:
    control, data = pack_ids(np.concatenate(ids))
    body = b"".join([np.array([x or 0 for x in docs], "<i8").tobytes(), bytes(x is not None for x in docs), np.array([len(x) for x in ids], "<i8").tobytes(), control, data])
    return struct.pack("<6Q", MARK, len(docs), sum(map(len, ids)), len(control), len(data), zlib.crc32(body)) + body


def blocks(f):
    """(doc_ids, list of values) of each block of an open file."""
    while head := f.read(48):
        mark, n_docs, n_ids, n_control, n_data, crc = struct.unpack("<6Q", head)
        body = f.read(17 * n_docs + n_control + n_data)
        if mark != MARK or zlib.crc32(body) != crc:
            raise ValueError("a block of a token file is damaged")
        at = 17 * n_docs
        valid = body[8 * n_docs : 9 * n_docs]
        docs = [int(x) if v else None for x, v in zip(np.frombuffer(body, "<i8", n_docs), valid, strict=True)]
        sizes = np.frombuffer(body, "<i8", n_docs, 9 * n_docs)
        values = unpack_ids(body[at : at + n_control], body[at + n_control :], n_ids)
        yield docs, np.split(values, np.cumsum(sizes)[:-1])


def write_token_files(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes the files; their folder, and a table of them: file, first id's place, number of ids."""
    with scratch():
        return _written(stored(tokenized(docs, path, end_id, id_col, text_col, counted=True), "tokens"), folder)


def _written(rows: DataFrame, folder: str | None) -> tuple[str, DataFrame]:
    spark = rows.sparkSession
    folder = folder or shared_folder(spark, "token-files")

    def count(batches):
        for batch in batches:
            for seen in batch.column(0).to_pylist():
                own, n = np.frombuffer(seen, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], names=["id", "n"])

    tables = rows.where("seen is not null").select("seen")  # one for each task that tokenized
    seen = tables.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").collect()  # a row for each id of the vocabulary at most
    by_rank = np.array([r["id"] for r in seen], "<u4")
    rank = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    fs, root = open_store(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/ranks") as f:
        f.write(by_rank.tobytes())
    ranks = spark.sparkContext.broadcast(rank)

    def write(batches):
        fs, root = open_store(folder)
        task = TaskContext.get()
        part, name = task.partitionId(), f"{root}/attempt-{task.taskAttemptId()}"
        held, docs_, n, total, f = [], [], 0, 0, None
        for batch in batches:
            for doc, size, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                f = f or fs.open_output_stream(name)
                docs_.append(doc)
                held.append(ranks.value[unpacked(data, size)])
                n, total = n + size, total + size
                if n >= BLOCK_IDS:
                    f.write(block(docs_, held))
                    held, docs_, n = [], [], 0
        if f:
            if docs_:
                f.write(block(docs_, held))
            f.close()
            settle(fs, name, f"{root}/part-{part:06d}")
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([part] if f else [], pa.int32()), pa.array([total] if f else [], pa.int64())], names=["part", "n"])

    # Many rows of one doc_id are dealt out by their order among themselves; equal rows by where they were.
    order = ["doc_id", "n_tokens", "tie", "part", "before"]
    ordered = rows.select("doc_id", "n_tokens", "ids", F.xxhash64("ids").alias("tie"), "part", "before").repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids")
    done = sorted((r["part"], r["n"]) for r in ordered.mapInArrow(write, "part int, n long").collect())
    base = offsets(done)
    return folder, spark.createDataFrame([(f"part-{p:06d}", base[p], n) for p, n in done], "file string, first long, n long").repartition(max(1, len(done)))


def read_token_files(folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (32 bits each) from the files."""

    def run(batches):
        fs, root = open_store(folder)
        with fs.open_input_file(f"{root}/ranks") as f:
            by_rank = np.frombuffer(f.read(), "<u4")
        for batch in batches:
            for file, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{file}") as raw:
                    for docs, values in blocks(raw):
                        n = np.array([len(x) for x in values], np.int64)
                        starts = at + np.cumsum(n) - n
                        at += int(n.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts), pa.array(n), pa.array([by_rank[x].tobytes() for x in values], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
        give_back()

    return files.select("file", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def token_files(docs: DataFrame, path: str, **kw) -> DataFrame:
    """Writes docs' ids and reads them back: doc_id, start, n_tokens, ids."""
    return read_token_files(*write_token_files(docs, path, **kw))


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of token_files' rows."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
