"""Packing by concatenating and cutting: token sequences of fixed size from whole documents.

Pass one tokenizes; each row carries its partition and the tokens before it there. The partitions' totals, one
number each, are summed up to global offsets. Pass two puts each document at its offset in one long stream of ids and
cuts the stream into windows; a record tells where each piece of a document lies. Only the last window is padded.

Defined results: null text counts as empty; an empty text is its end id alone; repeated rows are packed each; a null
doc_id is packed like any other; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, give_back, stored, utf8
from .tokens import library_memo


def tokenized(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", counted: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned little-endian, 16 bits where they fit), part, before.

    counted: also the task's ids and how often each occurs in it, as pairs of 64-bit numbers, in one of its rows (seen).
    """

    def encoded(batches):
        memo = library_memo(path)
        part, before, total = TaskContext.get().partitionId(), 0, np.zeros(1 << 16, np.int64)
        held = None
        for batch in (x for b in batches for x in by_bytes(b, 1)):
            ids = memo.encode(utf8(batch.column(1)))
            sizes = np.array([len(x) + 1 for x in ids], np.int64)
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            data = [np.append(x, end_id) for x in ids]
            if counted:
                own = np.bincount(np.concatenate(data))
                total = np.pad(total, (0, max(0, len(own) - len(total))))
                total[: len(own)] += own
            kind = "<u2" if all(x.max() < 1 << 16 for x in data) else "<u4"
            columns = [batch.column(0), pa.array(sizes), pa.array([x.astype(kind).tobytes() for x in data], pa.binary()), pa.array(np.full(len(data), part, np.int32)), pa.array(starts)]
            if held:
                yield held, None
            held = columns
        if held:
            own = np.flatnonzero(total)
            yield held, np.stack([own, total[own]]).astype("<i8").tobytes()
        memo.trim()

    def run(batches):
        for columns, seen in encoded(batches):
            names = ["doc_id", "n_tokens", "ids", "part", "before"]
            if counted:
                names.append("seen")
                columns.append(pa.array([seen] + [None] * (len(columns[0]) - 1), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, part int, before long" + (", seen binary" if counted else ""))


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")


def offsets(totals) -> dict[int, int]:
    """The ids before each partition, from (partition, total) pairs."""
    out, at = {}, 0
    for part, n in sorted(totals):
        out[part] = at
        at += n
    return out


def cut(rows: DataFrame, window: int) -> DataFrame:
    """The pieces of tokenized's rows."""
    base = offsets((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())

    def run(batches):
        for batch in batches:
            for own in by_bytes(batch, 2):
                out = [[] for _ in range(8)]
                for doc, n, data, part, before in zip(*(c.to_pylist() for c in own.columns), strict=True):
                    ids, first = unpacked(data, n), base[part] + before
                    start = 0
                    while start < n:
                        where = first + start
                        size = min(n - start, window - where % window)
                        piece = ids[start : start + size].tobytes()
                        for column, x in zip(out, (doc, start, size, zlib.crc32(piece), n, where // window, where % window, piece), strict=True):
                            column.append(x)
                        start += size
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:7]), pa.array(out[7], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
        give_back()

    return rows.select("doc_id", "n_tokens", "ids", "part", "before").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def pack(docs: DataFrame, path: str, end_id: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (32 bits each)."""
    return cut(stored(tokenized(docs, path, end_id, id_col, text_col), "tokens"), window)
