"""Encoding and decoding of columns."""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batch import BatchMerger, as_bytes
from ..model import OUT_OF_RANGE, TokenizerModel

#: Most rows of a table that is broadcast.
SMALL = 2_000_000
#: Words that a worker remembers, for each model, and the bytes that they and their ids take at most, but for those just met.
_WORDS, _BYTES = 300_000, 1 << 25
_memos: dict[str, _Memo] = {}
_mergers: dict[str, BatchMerger] = {}


class _Memo(dict):
    """Ids by word, as bytes; `held` bytes in all, with 4 for a character."""

    held = 0

    def learn(self, words: list[str], ids: list[bytes]) -> None:
        self.update(zip(words, ids))
        self.held += 4 * sum(map(len, words)) + sum(map(len, ids))

    def forget(self) -> None:
        """Back to half, if there is more than a worker may hold; those met first are the more frequent ones on the whole."""
        if len(self) <= _WORDS and self.held <= _BYTES:
            return
        gone, held = [], 0
        for i, (word, ids) in enumerate(self.items()):
            size = 4 * len(word) + len(ids)
            if i >= _WORDS // 2 or held + size > _BYTES // 2:
                gone.append(word)
            else:
                held += size
        for word in gone:
            del self[word]
        self.held = held


def parts(column: pa.Array, size: int = 1 << 20):
    """Slices of a column of texts or lists, in order, of about size bytes or items; a longer row stands in one slice."""
    length = pc.list_value_length if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length
    held = np.cumsum(pc.fill_null(length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(column)]
    for start, end in zip(cuts, cuts[1:]):
        if end > start:
            yield column.slice(start, end - start)


def _runs(model: TokenizerModel, part: list[str | None], size: int = 1 << 20, words: int = 1 << 17):
    """Lists of (row, ids before the words, words), in order: all rows of a part, but a text of more than size characters so many words at a time."""
    run = []
    for row, text in enumerate(part):
        text = text or ""
        if len(text) <= size:
            own = model.split(text)
            ids, used = model.head(text, own)
            run.append((row, ids, own[used:] if used else own))
            continue
        yield run
        run, rest, first = [], model.words_of(text), True
        while own := list(islice(rest, words)):
            ids, used = model.head(text, own) if first else ([], 0)
            yield [(row, ids, own[used:] if used else own)]
            first = False
    yield run


def small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has at most SMALL rows."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def encode_column(model: TokenizerModel):
    """A function from a text column to its ids (array<int>); null for null. A worker encodes each word it remembers once."""

    def run(texts: pa.Array) -> pa.Array:
        memo = _memos.setdefault(model.key, _Memo())
        if model.key not in _mergers:
            _mergers[model.key] = BatchMerger(model)
        merger = _mergers[model.key]
        flat, sizes = bytearray(), []  # ids stand together, so no list holds the whole batch in pieces
        for column in parts(texts):
            part = column.to_pylist()
            begins = len(sizes)
            sizes += [0] * len(part)
            for rows in _runs(model, part):
                new = list({w for _, _, words in rows for w in words if w not in memo})
                memo.learn(new, merger.word_ids(new))
                for row, head, words in rows:
                    ids = as_bytes(head) + b"".join(map(memo.__getitem__, words))
                    sizes[begins + row] += len(ids)
                    flat += ids
                memo.forget()
        ends = np.cumsum([0, *sizes]) // 4
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)), mask=texts.is_null() if texts.null_count else None)

    return F.arrow_udf(run, "array<int>")


def decode_column(model: TokenizerModel, strict: bool = True):
    """A function from ids to text; unknown ids and broken UTF-8 raise, or give null if not strict."""

    def run(batch: pa.Array) -> pa.Array:
        found = []
        for part in parts(batch, 1 << 18):  # a list of numbers takes many times its column's bytes
            out = []
            for ids in part.to_pylist():
                try:
                    out.append(None if ids is None else model.decode(ids))
                except ValueError:
                    if strict:
                        raise
                    out.append(None)
            found.append(pa.array(out, pa.string()))
        return pa.concat_arrays(found) if found else pa.array([], pa.string())

    return F.arrow_udf(run, "string")


def encode_words_native(words: Column, vocab: Column) -> Column:
    """String merging of short words without Python: an array of symbols and one of the ranks of their pairs.

    vocab: what vocab_map gives. Each step merges one pair and looks up the two pairs that it touches; a step copies the
    arrays, so the time is a word's symbols squared; for words, not for whole texts.
    """
    none = 2**31 - 1
    id_of = lambda x: F.try_element_at(F.element_at(vocab, (F.crc32(x) % F.size(vocab)).cast("int") + 1), x)
    rank = lambda a, b: F.coalesce(id_of(F.concat(a, b)), F.lit(none))
    no_ranks = F.array().cast("array<int>")

    def step(state: Column) -> Column:
        s, r = state["s"], state["r"]

        def merge(at: Column) -> Column:
            i, both = at["i"], at["both"]
            before = F.when(i > 1, F.array(rank(F.element_at(s, i - 1), both))).otherwise(no_ranks)
            after = F.when(i + 1 < F.size(s), F.array(rank(both, F.element_at(s, i + 2)))).otherwise(no_ranks)
            symbols = F.concat(F.slice(s, F.lit(1), i - 1), F.array(both), F.slice(s, i + 2, F.greatest(F.size(s) - i - 1, F.lit(0))))
            ranks = F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), before, after, F.slice(r, i + 2, F.greatest(F.size(r) - i - 1, F.lit(0))))
            return F.struct(symbols.alias("s"), ranks.alias("r"))

        joined = lambda i: F.struct(i.alias("i"), F.concat(F.element_at(s, i), F.element_at(s, i + 1)).alias("both"))
        merged = F.transform(F.transform(F.array(F.array_position(r, F.array_min(r)).cast("int")), joined), merge)[0]
        return F.when(F.array_min(r) < none, merged).otherwise(state)

    symbols = F.regexp_extract_all(words, F.lit(r"<0[xX][0-9a-fA-F]*>|[\s\S]"), F.lit(0))
    pairs = lambda s: F.when(F.size(s) > 1, F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1), rank)).otherwise(no_ranks)
    start = F.transform(F.array(symbols), lambda s: F.struct(s.alias("s"), pairs(s).alias("r")))[0]
    merged = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(words) - 1, F.lit(1))), start, lambda state, _: step(state), lambda state: state["s"])
    return F.transform(merged, lambda x: F.coalesce(id_of(x), F.lit(-1)))


def vocab_map(model: TokenizerModel) -> Column:
    """Maps from token to id, each token in that of its CRC-32: Spark reads a map from its first key on, so one map would take its whole length for each look-up."""
    tokens = sorted((t.decode(), i) for t, i in model.vocab.items())
    maps: list[list] = [[] for _ in tokens]
    for token, i in tokens:
        maps[zlib.crc32(token.encode()) % len(maps)] += [F.lit(token), F.lit(i)]
    return F.array(*[F.create_map(*x).cast("map<string,int>") for x in maps])


def valid_ids(ids: Column, model: TokenizerModel) -> Column:
    known = F.array(*[F.lit(i) for i in sorted(model.tokens)])
    top = max(model.tokens)
    if len(model.tokens) == top + 1:
        return ~F.exists(ids, lambda i: i.isNull() | (i < 0) | (i > top))
    return ~F.exists(ids, lambda i: i.isNull() | ~F.array_contains(known, i))


def decode_native(ids: Column, model: TokenizerModel) -> Column:
    """The model alphabet's text of ids, by a lookup in an array; raises for unknown ids."""
    top = max(model.tokens)
    table = F.array(*[F.lit(model.tokens[i].decode() if i in model.tokens else "") for i in range(top + 1)])
    joined = F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), "")
    return F.when(valid_ids(ids, model), joined).otherwise(F.raise_error(F.lit(OUT_OF_RANGE)))


def look_up(words: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """Ids of words by a join, a broadcast one for vocabularies of at most SMALL tokens; -1 where there is none."""
    return words.join(small(vocab), token, "left").withColumn("id", F.coalesce("id", F.lit(-1)))


def out_of_vocabulary(words: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """Words that are no token, with their counts."""
    return words.join(small(vocab), token, "left_anti").groupBy(token).agg(F.count("*").alias("n"))
