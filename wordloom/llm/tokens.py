"""Encoding of whole texts through a memo of their chunks, shared by the token operators.

Splitting patterns of the public tokenizers never let a token reach from a character into the white space behind
it, nor from a letter into a stop mark, so a text's ids are those of its chunks, each encoded alone. Chunks are found
with numpy on the bytes of many texts at once, equal ones are joined by Arrow's dictionary encoding, and a worker keeps
the ids of the chunks it has met, up to a bound, and encodes only new ones.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa

_LETTER, _SPACE, _STOP = 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[32, *range(9, 14)]] = _SPACE
_KIND[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~")] = _STOP  # not those of contractions (') and of ends of special tokens (>)
#: Other characters that some libraries count as space; texts with any are encoded as one chunk.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯　﻿]")
# First bytes that these characters have in UTF-8.
_MAY_BE_SPACE = np.zeros(256, bool)
_MAY_BE_SPACE[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_GAP = re.compile(rb"(?<=[^\t-\r ])[\t-\r ]")
# U+0130 is not among the letters: in lower case it ends with a mark that is none.
_LETTERS = "[A-Za-zÀ-ÖØ-öø-įı-ȿ]+"
_SPACED_WORD, _WORD = re.compile(f" {_LETTERS}"), re.compile(_LETTERS)


def chunk_starts(data: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Where chunks start in the UTF-8 bytes of texts, each followed by a line end at its place in separators.

    A chunk is a run of white space and the run of other characters behind it; stop marks that end such a run
    after a letter are a chunk of their own. Each separator is a chunk alone.
    """
    kind = _KIND[data]
    space, stop = kind == _SPACE, kind == _STOP
    start = np.empty(len(data), bool)
    start[0] = True
    np.greater(space[1:], space[:-1], out=start[1:])
    start[separators] = True
    start[separators[:-1] + 1] = True
    edges = np.flatnonzero(stop[1:] != stop[:-1]) + 1  # the last byte is a line end, so each run of stops ends
    if stop[0]:
        edges = edges[1:]
    first, behind = edges[::2], edges[1::2]
    last, lead = data[first - 1], data[np.maximum(first - 2, 0)]
    accented = (last >= 0x80) & (last < 0xC0) & (lead >= 0xC3) & (lead <= 0xC8) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7))) & ~((lead == 0xC4) & (last == 0xB0))
    start[first[space[behind] & ((kind[first - 1] == _LETTER) | accented)]] = True
    return np.flatnonzero(start)


def parts_of(text: bytes, size: int = 1 << 20) -> Iterable[bytes]:
    """A long text in parts that begin where chunks do."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + size)
        end = gap.start() if gap else len(text)
        yield text[start:end]
        start = end


def joined(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """All ids of lists in one array, and the lists' sizes."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes


class ChunkMemo:
    """Ids of chunks; `fresh` encodes a list of new ones to all their ids and each one's number of ids.

    Holds about `limit` chunks (more only while one step of `step` bytes has more) and 16 * limit bytes and ids of them;
    beyond that, and at a task's end, it forgets the half that fewest steps have met.
    """

    def __init__(self, fresh: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 500_000, step: int = 1 << 22):
        self.fresh, self.limit, self.step = fresh, limit, step
        self._clear()

    def _clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.starts, self.sizes, self.hits = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.flat, self.used, self.held = np.zeros(1 << 14, np.int32), 0, 0

    def trim(self, keep: int | None = None) -> None:
        """Forgets all but the `keep` chunks met most often."""
        keep = self.limit // 2 if keep is None else keep
        n = len(self.place)
        if n <= keep and max(self.used, self.held) <= 8 * self.limit:
            return
        names = list(self.place)
        best = np.argsort(-self.hits[:n], kind="stable")[:keep]
        sizes = self.sizes[best] + np.fromiter((len(names[i]) for i in best), np.int64, len(best))
        best = best[: max(1, int(np.searchsorted(np.cumsum(sizes), 8 * self.limit)))]
        sizes = self.sizes[best]
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.starts[best] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self.place = {names[i]: k for k, i in enumerate(best.tolist())}
        self.starts, self.sizes, self.hits = ends - sizes, sizes, self.hits[best] >> 1
        self.flat, self.used, self.held = flat, len(flat), sum(map(len, self.place))

    def _learn(self, new: list[bytes]) -> None:
        flat, sizes = self.fresh([x.decode("utf-8", "replace") for x in new])
        k, n = len(self.place), len(self.place) + len(new)
        if n > len(self.starts):
            self.starts, self.sizes, self.hits = (np.resize(x, n + n // 2) for x in (self.starts, self.sizes, self.hits))
        if self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, (self.used + len(flat)) * 3 // 2)
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[k:n], self.sizes[k:n], self.hits[k:n] = self.used + np.cumsum(sizes) - sizes, sizes, 0
        self.place.update(zip(new, range(k, n), strict=True))
        self.used += len(flat)
        self.held += sum(map(len, new))

    def _places(self, chunks: list[bytes]) -> np.ndarray:
        """Places of distinct chunks in the memo."""
        new = [x for x in chunks if x not in self.place]
        if new:
            if len(self.place) + len(new) > self.limit or max(self.used, self.held) > 16 * self.limit:
                self.trim()
                new = [x for x in chunks if x not in self.place]
            for i in range(0, len(new), 50_000):
                self._learn(new[i : i + 50_000])
        places = np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))
        self.hits[places] += 1
        return places

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        data = b"\n".join([*texts, b""])
        raw = np.frombuffer(data, np.uint8)
        separators = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        starts = chunk_starts(raw, separators)
        bounds = np.append(starts, len(raw)).astype(np.int32)
        chunks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        at = self._places(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]
        sizes, begins = self.sizes[at], self.starts[at]
        ends_of = np.searchsorted(starts, separators)
        sizes[ends_of] = 0
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1])]
        found = np.split(ids, ends[ends_of][:-1])
        odd = np.unique(np.searchsorted(separators, np.flatnonzero(_MAY_BE_SPACE[raw])))
        for i in odd:
            text = texts[i].decode("utf-8", "replace")
            if OTHER_SPACE.search(text):
                found[i] = self.fresh([text])[0]
        return found

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, given in UTF-8."""
        out: list[np.ndarray] = []
        held: list[bytes] = []
        size = 0
        for text in texts:
            if len(text) > self.step and not OTHER_SPACE.search(text.decode("utf-8", "replace")):  # goes in parts
                if held:
                    out += self._ids(held)
                    held, size = [], 0
                out.append(np.concatenate([self._ids([x])[0] for x in parts_of(text)]))
                continue
            held.append(text)
            size += len(text)
            if size >= self.step:
                out += self._ids(held)
                held, size = [], 0
        return out + self._ids(held) if held else out


class WholeTexts:
    """Stands for a memo where texts cannot be cut into chunks: encodes each whole."""

    def __init__(self, fresh: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], step: int = 1 << 22):
        self.fresh, self.step = fresh, step

    def trim(self) -> None:
        """Holds nothing."""

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        held: list[str] = []
        size = 0
        for i, text in enumerate(texts):
            held.append(text.decode("utf-8", "replace"))
            size += len(text)
            if size >= self.step or i == len(texts) - 1:
                flat, sizes = self.fresh(held)
                out += np.split(flat, np.cumsum(sizes)[:-1])
                held, size = [], 0
        return out


#: The parts of a tokenizers file, without vocabulary, whose texts can be cut into chunks: kinds of (normalizer, pre-tokenizer).
_GPT = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
_WORD_ENDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
_loaded: dict = {}


def library_memo(path: str) -> ChunkMemo:
    """A memo over a tokenizers file, one for each Python worker.

    New chunks that are plain words are encoded as one text and its ids cut by words: at the marks that ends of words
    have, or, for byte-level vocabularies, by the bytes that each token covers. Files whose normalizer and pre-tokenizer
    are none of the two known kinds have their texts encoded whole.
    """
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        parts = {k: v if v is None else json.loads(v.__getstate__()) for k, v in (("n", tokenizer.normalizer), ("p", tokenizer.pre_tokenizer))}
        many = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        vocab = tokenizer.get_vocab()
        kind = (parts["n"], parts["p"])
        byte_level = kind == _GPT
        covers, is_end = np.zeros(max(vocab.values()) + 1, np.int64), np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            covers[i], is_end[i] = len(token), token.endswith("</w>")
        plain = _SPACED_WORD if byte_level else _WORD

        def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            return joined([x.ids for x in many(texts, add_special_tokens=False)])

        def encode_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = encode(["".join(words) if byte_level else " ".join(words)])[0]
            if byte_level:
                ends = np.cumsum([len(x.encode()) for x in words])
                reached = np.cumsum(covers[ids])
                cuts = np.searchsorted(reached, ends)
                whole = len(reached) > 0 and reached[-1] == ends[-1] and bool((reached[cuts] == ends).all())
            else:
                cuts = np.flatnonzero(is_end[ids])
                whole = len(cuts) == len(words) and cuts[-1] == len(ids) - 1
            return (ids, np.diff(cuts, prepend=-1)) if whole else encode(words)

        def fresh(new: list[str]) -> tuple[np.ndarray, np.ndarray]:
            if not byte_level:
                new = [x.strip(" \t\n\x0b\x0c\r") for x in new]
            if not byte_level and not is_end.any():
                return encode(new)
            is_plain = np.fromiter((plain.fullmatch(x) is not None for x in new), bool, len(new))
            if not is_plain.any():
                return encode(new)
            order = np.argsort(~is_plain, kind="stable")  # plain words first
            words, rest = [new[i] for i in np.flatnonzero(is_plain)], [new[i] for i in np.flatnonzero(~is_plain)]
            (a, a_sizes), (b, b_sizes) = encode_words(words), encode(rest)
            ids, sizes = np.concatenate([a, b]), np.concatenate([a_sizes, b_sizes])
            back = np.empty(len(new), np.int64)
            back[order] = np.arange(len(new))
            begins = (np.cumsum(sizes) - sizes)[back]
            sizes = sizes[back]
            ends = np.cumsum(sizes)
            return ids[np.repeat(begins - ends + sizes, sizes) + np.arange(len(ids))], sizes

        _loaded[path] = ChunkMemo(fresh) if kind in (_GPT, _WORD_ENDS) else WholeTexts(encode)
    return _loaded[path]
