"""Merging of many words at once: all their symbols stand in one array, and each round merges one pair of each word."""

from __future__ import annotations

import numpy as np

from .model import LONG, TokenizerModel

_NONE = np.int64(1 << 30)
_PLACE = np.int64(32)
#: Fewer words than this are merged one by one.
FEW = 200
#: So many characters are merged at once.
STEP = 1 << 16


def as_bytes(ids) -> bytes:
    return np.asarray(ids, np.int32).tobytes()


class BatchMerger:
    """The same ids as model.word_ids gives, for lists of words, as 32-bit integers in bytes.

    A symbol is the id of its token. Characters without a token that stand in one get numbers above all ids, and others
    -1. The pairs that can merge are keys in a sorted array, with their rank (equal ranks are one number) and what they become.
    """

    def __init__(self, model: TokenizerModel):
        self.model, self.top = model, max(model.vocab.values())
        chars, pairs = self._of_rules() if model.merges is not None else self._of_tokens()
        self.chars = np.full(max(map(ord, chars), default=0) + 2, -1, np.int64)  # the last place stands for all further ones
        for c, symbol in chars.items():
            self.chars[ord(c)] = symbol
        keys = self._key(np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank = np.unique(np.array([r for r, _ in pairs.values()], np.int64), return_inverse=True)[1].astype(np.int64)[order]
        self.becomes = np.array([x for _, x in pairs.values()], np.int64)[order]
        # Where a byte has one character, and "<0" stays "<0", bytes lead to symbols without the mapped text.
        self.of_bytes = None
        if model.byte_mode and all(len(v) == 1 for v in model.special.values()) and not {"<", "0"} & {*model.special.values(), *map(chr, model.special)}:
            self.of_bytes = self._symbols("".join(model.special.get(b, chr(b)) for b in range(256)))

    def _symbols(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.chars[np.minimum(codes, len(self.chars) - 1)]

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left + 1).astype(np.uint64) << np.uint64(32) | (right + 1).astype(np.uint64)

    def _of_rules(self) -> tuple[dict, dict]:
        return {t: i for t, i in self.model.ids_of_text.items() if len(t) == 1}, self.model.merges

    def _of_tokens(self) -> tuple[dict, dict]:
        """Every cut of a token into two symbols is a pair, with the token's id as its rank."""
        known = dict(self.model.ids_of_text)
        for c in sorted({c for t in known for c in t} - known.keys()):
            known[c] = self.top + 1 + len(known)
        pairs = {}
        for token, i in self.model.ids_of_text.items():
            for at in range(1, len(token)):
                left, right = known.get(token[:at]), known.get(token[at:])
                if left is not None and right is not None:
                    pairs[left, right] = (i, i)
        return {t: i for t, i in known.items() if len(t) == 1}, pairs

    def _places(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pairs stand among the keys, and their ranks."""
        keys = self._key(left, right)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, np.where(self.keys[at] == keys, self.rank[at], _NONE)

    def word_ids(self, words: list[str]) -> list[bytes]:
        if len(words) < FEW or not len(self.keys):
            return [as_bytes(self.model.word_ids(w)) for w in words]
        out: list = [None] * len(words)
        held, texts, sizes, size = [], [], [], 0
        plain, units = self.of_bytes is not None, self.model.merges is None
        for i, word in enumerate(words):
            text = word if plain else self.model.pretokenize(word)
            n = len(text) if not plain or text.isascii() else len(text.encode())
            if not 0 < n < LONG or (units and "<0" in text):
                out[i] = as_bytes(self.model.word_ids(word))
                continue
            held.append(i)
            texts.append(text)
            sizes.append(n)
            size += n
            if size >= STEP:
                self._merge(held, texts, sizes, out)
                held, texts, sizes, size = [], [], [], 0
        if held:
            self._merge(held, texts, sizes, out)
        return out

    def _merge(self, held: list[int], texts: list[str], sizes: list[int], out: list) -> None:
        joined = "".join(texts)
        symbols = self._symbols(joined) if self.of_bytes is None else self.of_bytes[np.frombuffer(joined.encode(), np.uint8)]
        words, sizes = np.array(held, np.int64), np.array(sizes, np.int64)
        starts = np.cumsum(sizes) - sizes
        place, rank = np.zeros(len(symbols), np.int64), np.full(len(symbols), _NONE)
        place[:-1], rank[:-1] = self._places(symbols[:-1], symbols[1:])
        rank[starts + sizes - 1] = _NONE  # no pair reaches into the next word
        while len(words):
            best = np.minimum.reduceat(rank << _PLACE | np.arange(len(rank)), starts)
            going = best >> _PLACE < _NONE
            if not going.all():
                stays = np.repeat(going, sizes)
                self._done(words[~going], sizes[~going], symbols[~stays], out)
                symbols, place, rank = symbols[stays], place[stays], rank[stays]
                best = best[going] - (starts[going] - (np.cumsum(sizes[going]) - sizes[going]))
                words, sizes = words[going], sizes[going]
                starts = np.cumsum(sizes) - sizes
                if not len(words):
                    return
            at = best & np.int64((1 << 32) - 1)
            symbols[at] = self.becomes[place[at]]
            last = at + 2 == starts + sizes  # the pair was its word's last
            left = at > starts
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            symbols, place, rank = symbols[stays], place[stays], rank[stays]
            n = np.arange(len(words))
            at, starts, sizes = at - n, starts - n, sizes - 1
            rank[at[last]] = _NONE
            for x in (at[~last], at[left] - 1):
                place[x], rank[x] = self._places(symbols[x], symbols[x + 1])

    def _done(self, words: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, out: list) -> None:
        if self.model.merges is None:
            symbols = np.where(symbols > self.top, -1, symbols)
        flat, end = as_bytes(symbols), 0
        for i, n in zip(words.tolist(), (4 * sizes).tolist()):
            out[i] = flat[end : end + n]
            end += n
