"""Line dedup: sharded cuckoo filters in front of exact reference-count tables; documents can be taken back.

A line's key is the line without white space at its ends, A-Z lower-cased. The index keeps signed postings
(key, document, +1 or -1) and, from them, the exact table of reference counts: documents and largest doc_id of
each key. Keys found in at least `min_docs` documents also stand in the cuckoo filter of their shard; keys that
cross the bound upwards are inserted, keys that cross it downwards are deleted. A filter answers for nearly all
lines that they stay; the exact table decides the rest.

Keys are 128-bit hashes. Filters are broadcast while all of them together are at most `FILTER_BYTES`, and then texts
whose lines all stay are never moved. Beyond that, the keys of the documents go to their shard's filter instead, in
groups of about `GROUP_KEYS` that a hash of the document deals out, so that a very common line is asked for in many tasks.

Defined results: null or empty text is one empty line; each row counts as a document, rows that share a doc_id
included; a null doc_id counts but never is the largest, and its lines stay; an empty table gives no rows; only
the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, by_bytes, give_back, hot_join, scratch, stored, utf8

#: Most bytes of filters that are broadcast.
FILTER_BYTES = 32 << 20
#: Keys in one shard's filter, about.
SHARD_KEYS = 200_000
#: Keys of documents that are asked of one filter at once, about.
GROUP_KEYS = 1_000_000
#: Share of a filter's places that may be taken.
LOAD = 0.85


class CuckooFilter:
    """16-bit fingerprints in buckets of four; insert, delete and look up 64-bit keys.

    Equal fingerprints may be stored several times, so that a deletion takes back one insertion.
    """

    SLOTS = 4

    def __init__(self, capacity: int, table: bytes | None = None):
        self.n = 1 << max(1, int(np.ceil(np.log2(max(1, capacity) / self.SLOTS / LOAD))))
        self.table = np.zeros((self.n, self.SLOTS), np.uint16)
        if table is not None:
            self.table = np.frombuffer(table, np.uint16).reshape(-1, self.SLOTS).copy()
            self.n = len(self.table)
        self._pick = np.random.default_rng(6)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mixed = (keys ^ (keys >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        prints = (mixed >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = ((mixed >> np.uint64(8)) % np.uint64(self.n)).astype(np.int64)
        return prints, first, self._other(first, prints)

    def _other(self, at, prints):
        return at ^ ((prints.astype(np.int64) * 0x5BD1E995) & (self.n - 1))

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self._places(np.asarray(keys, np.uint64))
        return ((self.table[one] == prints[:, None]) | (self.table[two] == prints[:, None])).any(axis=1)

    def insert(self, keys: np.ndarray) -> list[int]:
        """Positions in keys that found no room; the caller builds a larger filter then."""
        prints, one, two = self._places(np.asarray(keys, np.uint64))
        full = []
        for i, (print_, a, b) in enumerate(zip(prints, one.tolist(), two.tolist(), strict=True)):
            if not self._put(print_, a, b):
                full.append(i)
        return full

    def _put(self, print_, a: int, b: int) -> bool:
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = print_
                return True
        at, moved = b, []
        for _ in range(500):
            slot = int(self._pick.integers(self.SLOTS))
            moved.append((at, slot, self.table[at, slot]))
            self.table[at, slot], print_ = print_, self.table[at, slot]
            at = int(self._other(at, print_))
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = print_
                return True
        for place, slot, old in reversed(moved):  # as it was: a failed insertion loses nothing
            self.table[place, slot] = old
        return False

    def delete(self, keys: np.ndarray) -> None:
        prints, one, two = self._places(np.asarray(keys, np.uint64))
        for print_, a, b in zip(prints, one.tolist(), two.tolist(), strict=True):
            for at in (a, b):
                held = np.flatnonzero(self.table[at] == print_)
                if len(held):
                    self.table[at, held[0]] = 0
                    break


def change_cells(filter_: CuckooFilter, listed: np.ndarray, keys: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Takes keys out of a filter and puts others (up) in; gives those without room, for the open list behind the cells.

    Keys in that list (listed) have no fingerprint in the cells, so nothing is taken out there for them.
    """
    down = keys[~up]
    filter_.delete(down[~np.isin(down, listed)])
    return keys[up][filter_.insert(keys[up])]


def line_key(line: bytes, min_chars: int) -> int | None:
    """128-bit key of a lower-cased line; None if it is too short to count."""
    line = line.strip(SPACE)
    if len(line) < min_chars or (len(line) < 4 * min_chars and len(line.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_intdigest(line)


def line_keys(text: bytes, min_chars: int) -> list[int | None]:
    return [line_key(x, min_chars) for x in text.lower().split(b"\n")]  # bytes.lower: A-Z alone


def _halves(keys) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(k.to_bytes(16, "little") for k in keys), np.int64).reshape(-1, 2)
    return raw[:, 0], raw[:, 1]


class LineIndex:
    """Reference counts of line keys, with insertion and deletion of documents."""

    def __init__(self, spark: SparkSession, min_docs: int = 5, min_chars: int = 40):
        self.spark, self.min_docs, self.min_chars = spark, min_docs, min_chars
        self.postings: list[DataFrame] = []
        self.counts: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.shards = 0

    def _keys(self, docs: DataFrame, sign: int) -> DataFrame:
        least = self.min_chars

        def run(batches):
            for batch in (x for b in batches for x in by_bytes(b, 1)):
                ids, keys, ns = [], [], []
                for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                    own = set(line_keys(text, least))
                    own.discard(None)
                    ids += [doc] * len(own)
                    keys += own
                low, high = _halves(keys)
                ns = np.full(len(ids), sign, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(ids, pa.int64()), pa.array(ns)], names=["k1", "k2", "doc_id", "sign"])
            give_back()

        return docs.mapInArrow(run, "k1 long, k2 long, doc_id long, sign int")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        return self._change(docs, id_col, text_col, 1)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Takes back documents that were inserted with these ids and texts."""
        return self._change(docs, id_col, text_col, -1)

    def _change(self, docs: DataFrame, id_col: str, text_col: str, sign: int) -> LineIndex:
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.postings.append(stored(self._keys(docs, sign), "line-postings"))
        held = self.postings[0]
        if len(self.postings) > 1:
            for more in self.postings[1:]:
                held = held.unionByName(more)
            held = held.groupBy("k1", "k2", "doc_id").agg(F.sum("sign").alias("sign")).where("sign > 0")
        counts = stored(held.groupBy("k1", "k2").agg(F.sum("sign").alias("n_docs"), F.max("doc_id").alias("keep_id")), "line-counts")
        self._refresh(self.counts, counts)
        self.counts = counts
        return self

    def hot(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs)

    def _refresh(self, before: DataFrame | None, after: DataFrame) -> None:
        """Brings the filters from the old counts to the new ones by insertions and deletions."""
        now = after.where(F.col("n_docs") >= self.min_docs).select("k1", "k2")
        if before is None:
            crossed = now.withColumn("up", F.lit(True))
        else:
            was = before.where(F.col("n_docs") >= self.min_docs).select("k1", "k2")
            crossed = now.join(was, ["k1", "k2"], "left_anti").withColumn("up", F.lit(True)).unionByName(was.join(now, ["k1", "k2"], "left_anti").withColumn("up", F.lit(False)))
        n = now.count()
        needed = max(1, -(-n // SHARD_KEYS))
        if self.filters is not None and (needed > 4 * self.shards or n > LOAD * self._slots()):  # shards have grown too large or too full: all anew
            self.filters, crossed = None, now.withColumn("up", F.lit(True))
        if self.filters is None:
            self.shards = needed
        shards = self.shards
        keyed = crossed.select(F.pmod("k2", F.lit(shards)).cast("int").alias("shard"), "k1", "k2", "up")
        old = self.filters if self.filters is not None else self.spark.createDataFrame([], "shard int, keys long, cells binary")

        def run(key, held: pa.Table, changes: pa.Table) -> pa.Table:
            shard = (held if held.num_rows else changes).column("shard")[0].as_py()
            keys = changes.column("k1").to_numpy().view(np.uint64) if changes.num_rows else np.empty(0, np.uint64)
            up = changes.column("up").to_numpy(zero_copy_only=False).astype(bool) if changes.num_rows else np.empty(0, bool)
            count = held.column("keys")[0].as_py() if held.num_rows else 0
            filter_ = CuckooFilter(2 * int(up.sum()) + 64, held.column("cells")[0].as_py() if held.num_rows else None)
            listed = (held.column("rest")[0].as_py() or []) if held.num_rows else []
            rest = change_cells(filter_, np.array(listed, np.int64).view(np.uint64), keys, up)
            cells = filter_.table.tobytes()
            return pa.table({"shard": pa.array([shard], pa.int32()), "keys": pa.array([count + int(up.sum()) - int((~up).sum())], pa.int64()), "cells": pa.array([cells], pa.binary()), "rest": pa.array([rest.view(np.int64).tolist()], pa.list_(pa.int64()))})

        if "rest" not in old.columns:
            old = old.withColumn("rest", F.lit(None).cast("array<long>"))
        grown = old.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInArrow(_keeping_rest(run), "shard int, keys long, cells binary, rest array<long>")
        self.filters = stored(grown, "line-filters")

    def _slots(self) -> int:
        """Room for fingerprints in all filters."""
        return self.filters.agg(F.coalesce(F.sum(F.length("cells")), F.lit(0)).alias("n")).first()["n"] // 2

    def candidates(self, docs: DataFrame, texts: bool, filter_bytes: int) -> DataFrame:
        """For each row: its lines' number and, if a filter may know one of its keys (or texts is asked for), the text; and those keys."""
        least, shards = self.min_chars, self.shards
        size = self.filters.agg(F.coalesce(F.sum(F.length("cells") + 8 * F.size("rest")), F.lit(0)).alias("n")).first()["n"]
        known = None
        if size <= filter_bytes:
            known = self.spark.sparkContext.broadcast({r["shard"]: (r["cells"], r["rest"]) for r in self.filters.collect()})

        def run(batches):
            filters = {}
            if known is not None:
                filters = {s: (CuckooFilter(1, bytes(cells)), set(rest or ())) for s, (cells, rest) in known.value.items()}
            for batch in (x for b in batches for x in by_bytes(b, 1)):
                whole = utf8(batch.column(1))
                split = [line_keys(t, least) for t in whole]
                flat = [k for keys in split for k in keys if k is not None]
                low, high = _halves(flat)
                hit = np.ones(len(flat), bool)
                if known is not None:
                    of = high % shards
                    hit[:] = False
                    for shard, (cells, rest) in filters.items():
                        own = np.flatnonzero(of == shard)
                        hit[own] = cells.contains(low[own].view(np.uint64))
                        if rest:
                            hit[own] |= np.isin(low[own], list(rest))
                out, at = [[] for _ in range(4)], 0
                for text, keys in zip(whole, split, strict=True):
                    n = sum(k is not None for k in keys)
                    which = np.flatnonzero(hit[at : at + n]) + at
                    at += n
                    found = dict.fromkeys(zip(low[which].tolist(), high[which].tolist(), strict=True))
                    for part, x in zip(out, (len(keys), None if found else hashlib.sha256(text).hexdigest(), text.decode() if found or texts else None, [{"k1": a, "k2": b} for a, b in found]), strict=True):
                        part.append(x)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, kind) for x, kind in zip(out, kinds, strict=True))], names=["doc_id", "n_lines", "whole_sha256", "text", "keys"])
            give_back()

        return docs.mapInArrow(run, "doc_id long, n_lines long, whole_sha256 string, text string, keys array<struct<k1: long, k2: long>>")

    def known(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (doc_id, k1, k2) whose filter knows the key, each asked where its shard's filter is."""
        n, shards = keys.count(), self.shards
        salts = max(1, -(-n // (shards * GROUP_KEYS)))
        keys = keys.withColumn("shard", F.pmod("k2", F.lit(shards)).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        filters = self.filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

        def run(key, held: pa.Table, asked: pa.Table) -> pa.Table:
            asked = asked.select(["doc_id", "k1", "k2"])
            if not held.num_rows or not asked.num_rows:
                return asked.slice(0, 0)
            own = asked.column("k1").to_numpy()
            hit = CuckooFilter(1, held.column("cells")[0].as_py()).contains(own.view(np.uint64)) | np.isin(own, held.column("rest")[0].as_py() or [])
            return asked.filter(pa.array(hit))

        return filters.groupBy("shard", "salt").cogroup(keys.groupBy("shard", "salt")).applyInArrow(run, "doc_id long, k1 long, k2 long")

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, filter_bytes: int = FILTER_BYTES) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept_sha256 (and kept_text, where texts is asked for) of each row of docs."""
        docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        with scratch() as keep:
            found = stored(self.candidates(docs, texts, filter_bytes), "line-candidates")
            keys = found.where("size(keys) > 0").select("doc_id", F.explode("keys").alias("k")).select("doc_id", "k.k1", "k.k2")
            size = self.filters.agg(F.coalesce(F.sum(F.length("cells") + 8 * F.size("rest")), F.lit(0)).alias("n")).first()["n"]
            keys = keys if size <= filter_bytes else self.known(keys)
            lost = hot_join(keys, self.hot().select("k1", "k2", "n_docs", "keep_id"), ["k1", "k2"], "n_docs", "inner").where("doc_id < keep_id")
            lost = lost.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("lost"))
            keep(found)
        least = self.min_chars

        def run(batches):
            for batch in (x for b in batches for x in by_bytes(b, 2)):
                out = [[], [], []]
                for text, lost in zip(utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                    lines = text.split(b"\n")
                    if lost:
                        gone = {(x["k1"], x["k2"]) for x in lost}
                        of = line_keys(text, least)
                        low, high = _halves([k or 0 for k in of])
                        stay = [line for line, k, a, b in zip(lines, of, low.tolist(), high.tolist(), strict=True) if k is None or (a, b) not in gone]
                    else:
                        stay = lines
                    kept = b"\n".join(stay)
                    for part, x in zip(out, (len(lines) - len(stay), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None), strict=True):
                        part.append(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.string(), pa.string()), strict=True))], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])
            give_back()

        changed = found.where("whole_sha256 is null").join(lost, "doc_id", "left").select("doc_id", "n_lines", "text", "lost")
        changed = changed.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string")
        same = found.where("whole_sha256 is not null").select("doc_id", "n_lines", F.lit(0).cast("long").alias("n_dropped"), F.col("whole_sha256").alias("kept_sha256"), F.col("text").alias("kept_text"))
        out = same.unionByName(changed)
        return out if texts else out.drop("kept_text")


def _keeping_rest(run):
    """Keys that once found no room stay listed until they are deleted."""

    def with_rest(key, held: pa.Table, changes: pa.Table) -> pa.Table:
        out = run(key, held, changes)
        before = set((held.column("rest")[0].as_py() or []) if held.num_rows else [])
        if changes.num_rows:
            gone = changes.filter(pa.compute.invert(changes.column("up"))).column("k1").to_pylist()
            before -= set(gone)
        rest = sorted(before | set(out.column("rest")[0].as_py()))
        return out.set_column(3, "rest", pa.array([rest], pa.list_(pa.int64())))

    return with_rest


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, min_chars: int = 40, texts: bool = False) -> DataFrame:
    """Indexes docs and drops their repeated lines."""
    index = LineIndex(docs.sparkSession, min_docs, min_chars).insert(docs, id_col, text_col)
    return index.apply(docs, id_col, text_col, texts)
