"""Exact dedup by content-defined chunk recipes.

A text without its white space is cut where a rolling hash of the last 32 bytes hits a pattern, so equal
passages give equal chunks. Each chunk has a 64-bit identifier, verified against the chunk's SHA-256. Identifiers that
different chunks share (of n chunks about n * n / 2^65, none as a rule) are listed, and texts with one of them are
compared by their chunks' SHA-256 too. Texts are equal if their ordered lists of verified identifiers are; only those
lists are shuffled, never the texts, and groups that hold a thousandth of all rows are joined without a shuffle.

Defined results: null text counts as empty, and empty texts equal each other; repeated rows are members like any
other; a null doc_id stays behind any other of equal length; of rows that tie in all that, the first by the row key
is the one to keep, where a row key is given; an empty table gives no rows; only the id and text
columns are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, by_bytes, give_back, hot_join, scratch, stored, utf8

#: A random number for each byte value, from a fixed seed.
_GEAR = np.random.default_rng(10).integers(0, 1 << 32, 256, dtype=np.uint32)
_FORMAT = "doc_id long, n_chars long, recipe array<long>, proofs array<binary>, text_sha256 string"


def cut_points(data: bytes, least: int = 2048, bits: int = 12, most: int = 16384, block: int = 1 << 22) -> list[int]:
    """Ends of the chunks of data: content-defined, `least` to `most` bytes apart (the last may be shorter)."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    found = []
    for at in range(0, n, block):  # blocks overlap by the window, so memory stays bounded
        raw = np.frombuffer(data, np.uint8, min(n, at + block) - max(0, at - 31), max(0, at - 31))
        h = _GEAR[raw]
        for step in (1, 2, 4, 8, 16):
            h[step:] += h[:-step] << np.uint32(step)
        hits = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + max(0, at - 31) + 1
        found.append(hits[hits > at])
    ends, last = [], 0
    for hit in [*np.concatenate(found).tolist(), n]:
        while hit - last > most:
            last += most
            ends.append(last)
        if hit - last >= least or hit == n and hit > last:
            ends.append(hit)
            last = hit
    return ends


def recipe(data: bytes, id_bits: int = 64, **cut) -> tuple[list[int], list[bytes]]:
    """Chunk identifiers of data in order, and the SHA-256 of each chunk."""
    ids, proofs, last = [], [], 0
    for end in cut_points(data, **cut):
        chunk = data[last:end]
        h = xxhash.xxh3_64_intdigest(chunk) & ((1 << id_bits) - 1)
        ids.append(h - (1 << 64) if h >> 63 else h)
        proofs.append(hashlib.sha256(chunk).digest())
        last = end
    return ids, proofs


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64, row_col: str | None = None) -> DataFrame:
    """One row for each document: length, chunk identifiers, proofs, SHA-256 of the text without white space; and its row key, where one is given."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *([F.col(row_col).alias("row")] if row_col else []))
    extra = f", row {rows.schema['row'].dataType.simpleString()}" if row_col else ""

    def run(batches):
        for batch in (x for b in batches for x in by_bytes(b, 1)):
            out = [[], [], []]
            for raw in utf8(batch.column(1)):
                data = raw.translate(None, SPACE)
                ids, proofs = recipe(data, id_bits)
                for part, x in zip(out, (ids, proofs, proofs[0].hex() if len(proofs) == 1 else hashlib.sha256(data).hexdigest()), strict=True):
                    part.append(x)
            length = pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), length, pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.list_(pa.binary())), pa.array(out[2], pa.string()), *batch.columns[2:]],
                names=["doc_id", "n_chars", "recipe", "proofs", "text_sha256", *(["row"] if extra else [])],
            )
        give_back()

    return rows.mapInArrow(run, _FORMAT + extra)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64, row_col: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs.

    With row_col, a column that is another in each row, also `row`, and kept holds for one row of a group.
    """
    with scratch() as keep:
        made = stored(recipes(docs, id_col, text_col, id_bits, row_col), "recipes")
        chunks = made.select(F.explode(F.arrays_zip("recipe", "proofs")).alias("c"))
        shared = [r["recipe"] for r in chunks.groupBy("c.recipe").agg(F.min("c.proofs").alias("low"), F.max("c.proofs").alias("high")).where("low <> high").select("recipe").collect()]
        unsure = F.arrays_overlap("recipe", F.array(*map(F.lit, shared)).cast("array<long>"))
        keyed = made.withColumn("key", F.struct("recipe", F.when(unsure, F.col("proofs")).alias("proofs")) if shared else F.col("recipe"))
        order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", *(["row"] if row_col else []))
        groups = stored(keyed.groupBy("key").agg(F.count("*").alias("group_size"), F.min(order).alias("best")).where("group_size > 1"), "recipe-groups")
        keep(made, groups)
    rows = hot_join(keyed, groups, ["key"], "group_size")
    alone = F.col("group_size").isNull()
    return rows.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(alone, True).otherwise(F.col("row") == F.col("best.row") if row_col else F.col("doc_id").eqNullSafe(F.col("best.doc_id"))).alias("kept"),
        "text_sha256",
        *(["row"] if row_col else []),
    )
