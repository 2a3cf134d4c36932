"""Byte-level BPE encoding and decoding with length-bucketed padded numpy matrices.

Pieces of a splitting pattern become rows of token ids, bytes first. Rows of similar length share a padded matrix;
each round every row merges its leftmost pair of minimum rank. Pair ranks come from a hashed open-addressing table,
only those beside a merge are looked up anew, and rows without a mergeable pair leave the matrix. Pieces beyond
`LONG` bytes, for which rounds of a whole matrix would take quadratic time, make the same merges from a heap.

Defined results: null text counts as empty and gives no ids; repeated rows are encoded each; an unknown id raises
ValueError in decoding; an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, give_back, utf8
from .tokens import ChunkMemo, WholeTexts, joined

LONG = 4096
_NONE = np.int32(2**31 - 1)
_models: dict = {}


class PairTable:
    """rank(left id, right id) by hashing; numpy arrays throughout."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(rank)) * 2.5))))
        size = 1 << self.bits
        self.keys, self.ranks, self.reach = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32), 0
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at, todo = self._hash(keys), np.arange(len(keys))
        while len(todo):  # all that are left try the next slot; of several, the last written has it
            self.reach += 1
            free = todo[self.keys[at[todo]] == -1]
            self.keys[at[free]] = keys[free]
            won = free[self.keys[at[free]] == keys[free]]
            self.ranks[at[won]] = rank[won]
            todo = np.setdiff1d(todo, won)
            at[todo] = (at[todo] + 1) & (size - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a side of -1 has none."""
        keys = left.astype(np.int64).ravel() << 32 | (right.astype(np.int64).ravel() & 0xFFFFFFFF)
        out = np.full(len(keys), _NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        at = self._hash(keys[todo])
        for _ in range(self.reach):
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (held != -1)
            todo, at = todo[on], (at[on] + 1) & (len(self.keys) - 1)
            if not len(todo):
                break
        return out.reshape(left.shape)


class ByteBpe:
    """Ranks, where a token's rank is its id and any pair whose bytes are a token can merge; pattern: without groups."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {i: b for b, i in ranks.items()}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        triples = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*np.array(triples, np.int32).reshape(-1, 3).T)
        # Only of the public pattern is it known where a text can be cut.
        self.memo = (ChunkMemo if pattern == public_tokenizers.PATTERN else WholeTexts)(lambda new: joined(self.encode_new(new)))

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        """The model of a rank file, read once in each worker."""
        if (path, pattern) not in _models:
            with open(path, "rb") as f:
                _models[path, pattern] = cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}, pattern)
        return _models[path, pattern]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.memo.encode([x.encode() for x in texts])

    def encode_new(self, texts: list[str]) -> list[list[int]]:
        split = [[x for x in self.pattern.findall(t) if x] for t in texts]
        known = {x: None for parts in split for x in parts}
        for piece, ids in zip(known, self.merge([x.encode() for x in known]), strict=True):
            known[piece] = ids
        return [[i for x in parts for i in known[x]] for parts in split]

    def merge(self, pieces: list[bytes], cells: int = 1 << 20) -> list[list[int]]:
        """Ids of each piece; a piece that is a token as a whole is that token."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if piece in self.ranks:
                out[i] = [self.ranks[piece]]
            elif len(piece) > LONG:
                out[i] = self._merge_long(piece)
            else:
                buckets.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for bits, own in buckets.items():
            step = max(1, cells >> bits)
            for at in range(0, len(own), step):
                part = own[at : at + step]
                for i, ids in zip(part, self._merge_rows([pieces[i] for i in part], 1 << bits), strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[list[int]]:
        sizes = np.array([len(x) for x in pieces])
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list = [None] * len(pieces)
        of = np.arange(len(pieces))
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(of):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(of), int)
            best = rank[np.arange(len(of)), at] if rank.shape[1] else np.full(len(of), _NONE)
            done = best == _NONE
            if done.any():
                for i, row in zip(of[done], ids[done], strict=True):
                    out[i] = row[row >= 0].tolist()
                of, ids, rank, at, best = of[~done], ids[~done], rank[~done], at[~done], best[~done]
                if not len(of):
                    break
            row, width = np.arange(len(of)), ids.shape[1]
            ids[row, at] = best
            step = np.arange(width - 1)
            ids = np.take_along_axis(ids, step + (step > at[:, None]), 1)
            step = np.arange(width - 2)
            rank = np.take_along_axis(rank, step + (step >= at[:, None]), 1)
            if width == 2:
                continue
            left = at > 0
            rank[row[left], at[left] - 1] = self.pairs.find(ids[row[left], at[left] - 1], ids[row[left], at[left]])
            right = at < width - 2
            rank[row[right], at[right]] = self.pairs.find(ids[row[right], at[right]], ids[row[right], at[right] + 1])
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        token = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(token) + 1)), list(range(-1, len(token) - 1))
        heap = [(r, i) for i in range(len(token) - 1) if (r := self.ranks.get(token[i] + token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if token[i] is None or j >= len(token) or self.ranks.get(token[i] + token[j]) != r:
                continue
            token[i], token[j] = token[i] + token[j], None
            after[i] = after[j]
            if after[i] < len(token):
                before[after[i]] = i
                if (r := self.ranks.get(token[i] + token[after[i]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := self.ranks.get(token[before[i]] + token[i])) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [self.ranks[x] for x in token if x is not None]

    def decode(self, ids) -> bytes:
        try:
            return b"".join(map(self.token.__getitem__, np.asarray(ids).tolist()))
        except KeyError as e:
            raise ValueError(f"no token has the id {e}") from e


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each text."""

    def run(batches):
        model = ByteBpe.load(path, pattern)
        for batch in (x for b in batches for x in by_bytes(b, 1)):
            ids = model.memo.encode(utf8(batch.column(1)))
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "ids"])
        model.memo.trim()
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and the decoded bytes of each row; null ids give no bytes."""

    def run(batches):
        model = ByteBpe.load(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                own = batch.slice(at, 500)
                data = [model.decode(x.values) if x.is_valid else b"" for x in own.column(1)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(data, pa.binary())], names=["doc_id", "ids", "data"])
        give_back()

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of each text's ids, and of the bytes that they decode to.

    Encodes and decodes in one worker, so that a task needs one model and ids need not travel.
    """

    def run(batches):
        model = ByteBpe.load(path, pattern)
        for batch in (x for b in batches for x in by_bytes(b, 1)):
            out = [[], [], []]
            for ids in model.memo.encode(utf8(batch.column(1))):
                for column, x in zip(out, (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids)).hexdigest()), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        model.memo.trim()
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
