"""A tokenizer's data: vocabulary, special bytes, merge rules, prefix and word pattern; and its text files.

A model is immutable and can be pickled, so it travels to executors as it is. Tokens are bytes, since trained ones
may end inside a character.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import logging
import os
import re
import sys
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

import regex

log = logging.getLogger("wordloom")

# The letters of the word pattern beyond ASCII.
LETTERS = "áéíóúőűüöÁÉÍÓÚŐŰÜÖ"
#: Words in order of preference: letters, digits or other characters, each with one space before; spaces; any one.
WORD_PATTERN = rf" ?[A-Za-z{LETTERS}]+| ?[0-9]+| ?[^ \t\n\x0B\f\rA-Za-z{LETTERS}0-9]+| +|[\s\S]"
SYMBOL = re.compile(rb"<0[xX][0-9a-fA-F]*>|[\x00-\x7f\x80-\xbf]|[\xc0-\xff][\x80-\xbf]*")

OUT_OF_RANGE = "Element must be non-negative and less than vocab size."
BAD_VOCAB = "Invalid format in vocab file."
#: Symbols from which on a word is merged from a heap.
LONG = 128
_NONE = 1 << 62


def initialize_logging() -> None:
    """Debug messages go to standard error, with their time, where the environment has DEBUG=1."""
    if os.environ.get("DEBUG") == "1" and not log.handlers:
        handler = logging.StreamHandler(sys.stderr)
        handler.setFormatter(logging.Formatter("[%(asctime)s] DEBUG: %(message)s", "%Y-%m-%d %H:%M:%S"))
        log.addHandler(handler)
        log.setLevel(logging.DEBUG)


def merged(symbols: list, rank_of, join) -> list:
    """Symbols after merging, again and again, the leftmost neighbours of lowest rank.

    rank_of(a, b): a rank, or None where the two cannot merge; join(a, b): what they become.
    """
    if len(symbols) >= LONG:
        return _merged_from_heap(symbols, rank_of, join)
    s = symbols
    ranks = [_NONE if (r := rank_of(a, b)) is None else r for a, b in zip(s, s[1:])]
    while ranks and (best := min(ranks)) != _NONE:
        at = ranks.index(best)
        s[at : at + 2] = [join(s[at], s[at + 1])]
        del ranks[at]
        for i in (at - 1, at):
            if 0 <= i < len(ranks):
                ranks[i] = _NONE if (r := rank_of(s[i], s[i + 1])) is None else r
    return s


def _merged_from_heap(s: list, rank_of, join) -> list:
    """The same in time n log n: candidates wait in a heap by rank and place; those whose sides have changed are passed over."""
    n = len(s)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    version = [0] * n  # grows whenever a place's symbol changes or goes
    heap = [(r, i, 0, 0) for i in range(n - 1) if (r := rank_of(s[i], s[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, own, other = heapq.heappop(heap)
        j = after[i]
        if j >= n or version[i] != own or version[j] != other:
            continue
        s[i] = join(s[i], s[j])
        version[i], version[j] = own + 1, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank_of(s[i], s[k])) is not None:
                heapq.heappush(heap, (r, i, version[i], version[k]))
        h = before[i]
        if h >= 0 and (r := rank_of(s[h], s[i])) is not None:
            heapq.heappush(heap, (r, h, version[h], version[i]))
    return [x for x, v in zip(s, version) if v >= 0]


def byte_alphabet() -> dict[int, str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def special_bytes() -> dict[int, str]:
    """The bytes that byte_alphabet moves to another character."""
    return {b: c for b, c in byte_alphabet().items() if c != chr(b)}


@dataclass(frozen=True)
class TokenizerModel:
    """vocab: token to id. special: byte to replacement. merges: (left id, right id) to (rank, merged id).

    Without merges, a pair's rank is the id of its concatenation. pattern None: WORD_PATTERN, else a regular
    expression whose matches are the words (text between matches is left out).
    """

    vocab: dict[bytes, int]
    special: dict[int, str] = field(default_factory=dict)
    merges: dict[tuple[int, int], tuple[int, int]] | None = None
    prefix: str | None = None
    byte_mode: bool = False
    pattern: str | None = None

    def __post_init__(self):
        if not self.vocab:
            raise ValueError("Vocab file is empty.")
        if min(self.vocab.values()) < 0 or max(self.vocab.values()) > 2**31 - 1:
            raise ValueError("Token id is out of range.")
        if any(not v for v in self.special.values()):
            raise ValueError("A special character has no replacement.")
        if len(set(self.vocab.values())) < len(self.vocab):
            raise ValueError("A token id occurs twice in the vocab.")

    @cached_property
    def tokens(self) -> dict[int, bytes]:
        return {i: t for t, i in self.vocab.items()}

    @cached_property
    def reverse(self) -> dict[str, int]:
        return {v: b for b, v in sorted(self.special.items())}

    @cached_property
    def key(self) -> str:
        """The same for models that encode and decode alike."""
        parts = (sorted(self.vocab.items()), sorted(self.special.items()), sorted((self.merges or {}).items()), self.merges is None, self.prefix, self.byte_mode, self.pattern)
        return hashlib.sha256(repr(parts).encode()).hexdigest()

    @cached_property
    def words(self):
        return re.compile(WORD_PATTERN, re.A) if self.pattern is None else longest_matches(self.pattern)

    @cached_property
    def ids_of_text(self) -> dict[str, int]:
        """The ids of those tokens that are text."""
        out = {}
        for token, i in self.vocab.items():
            try:
                out[token.decode()] = i
            except UnicodeDecodeError:
                continue
        return out

    @cached_property
    def _mapped(self) -> dict[int, str]:
        return {b: v for b, v in self.special.items()}

    @cached_property
    def bytes_of(self) -> dict[int, bytes] | None:
        """What each id decodes to by itself; None where neighbouring tokens can form a replacement or a character together."""
        if any(len(v) > 1 for v in self.special.values()):
            return None
        try:
            return {i: self._plain(t.decode()) for i, t in self.tokens.items()} if self.special or self.byte_mode else dict(self.tokens)
        except UnicodeDecodeError:
            return None

    # --- text to symbols and back

    def pretokenize(self, text: str, prefix: str | None = None) -> str:
        if self.byte_mode:
            out = text.encode().decode("latin-1").translate(self._mapped)
        else:
            out = "".join(self.special.get(c.encode()[0]) or c for c in text) if self.special else text
        return (prefix or "") + out

    @cached_property
    def _units(self) -> re.Pattern:
        return re.compile("|".join([*map(re.escape, sorted(self.reverse, key=len, reverse=True)), r"[\s\S]"]))

    def _plain(self, text: str) -> bytes:
        """The bytes of mapped text, longest replacements first."""
        out = bytearray()
        for m in self._units.finditer(text):
            x = m.group()
            if x in self.reverse:
                out.append(self.reverse[x])
            elif self.byte_mode:
                out.append(ord(x) if ord(x) < 256 else ord("?"))
            else:
                out += x.encode()
        return bytes(out)

    def detokenize(self, text: str) -> bytes:
        return self._plain(text.removeprefix(self.prefix) if self.prefix else text)

    # --- merging

    def merge_strings(self, word: bytes, units: bool = True) -> list[int]:
        """Merges the leftmost pair whose concatenation has the lowest id until none is a token; -1: no token."""
        get = self.vocab.get
        s = SYMBOL.findall(word) if units else [c.encode() for c in word.decode()]
        return [get(x, -1) for x in merged(s, lambda a, b: get(a + b), lambda a, b: a + b)]

    def merge_text(self, word: str) -> list[int]:
        """merge_strings of a word in which no "<" starts a unit, character by character."""
        get = self.ids_of_text.get
        if len(word) >= LONG:
            return [get(x, -1) for x in merged(list(word), lambda a, b: get(a + b), lambda a, b: a + b)]
        s = list(word)
        ranks = [get(a + b, _NONE) for a, b in zip(word, word[1:])]
        while ranks and (best := min(ranks)) != _NONE:
            at = ranks.index(best)
            del ranks[at]
            s[at] = both = s[at] + s.pop(at + 1)
            if at:
                ranks[at - 1] = get(s[at - 1] + both, _NONE)
            if at < len(ranks):
                ranks[at] = get(both + s[at + 1], _NONE)
        return [get(x, -1) for x in s]

    @cached_property
    def _rank_of_pair(self) -> dict[tuple[int, int], int]:
        return {pair: rank for pair, (rank, _) in self.merges.items()}

    @cached_property
    def _id_of_char(self) -> dict[str, int]:
        return {t: i for t, i in self.ids_of_text.items() if len(t) == 1}

    def merge_ids(self, word: bytes) -> list[int]:
        """Merges the leftmost pair of lowest rule rank until no rule fits; unknown characters are -1 and stay."""
        rules, get, char = self.merges, self._rank_of_pair.get, self._id_of_char.get
        s = [char(c, -1) for c in word.decode()]
        if len(s) >= LONG:
            return merged(s, lambda a, b: get((a, b)), lambda a, b: rules[a, b][1])
        ranks = [get(pair, _NONE) for pair in zip(s, s[1:])]
        while ranks and (best := min(ranks)) != _NONE:
            at = ranks.index(best)
            del ranks[at]
            s[at] = both = rules[s[at], s.pop(at + 1)][1]
            if at:
                ranks[at - 1] = get((s[at - 1], both), _NONE)
            if at < len(ranks):
                ranks[at] = get((both, s[at + 1]), _NONE)
        return s

    def word_ids(self, word: str, prefix: str | None = None) -> list[int]:
        mapped = self.pretokenize(word, prefix)
        if self.merges is not None:
            return self.merge_ids(mapped.encode())
        return self.merge_strings(mapped.encode()) if "<0" in mapped else self.merge_text(mapped)

    @cached_property
    def prefix_ids(self) -> list[int]:
        """What stands before a text that starts with a space: always merged by strings, character by character."""
        return self.merge_strings(self.pretokenize(self.prefix).encode(), units=False) if self.prefix else []

    def split(self, text: str) -> list[str]:
        words = self.words.findall(text) if self.words.groups == 0 else [m.group() for m in self.words.finditer(text)]
        return words if self.pattern is None else [w for w in words if w]

    def words_of(self, text: str):
        """split, one word after the other, for long texts, whose words take many times the text's memory."""
        found = (m.group() for m in self.words.finditer(text))
        return found if self.pattern is None else filter(None, found)

    def head(self, text: str, words: list[str]) -> tuple[list[int], int]:
        """The ids that a text begins with because of the prefix, and how many of its words they stand for."""
        if not words or not self.prefix:
            return [], 0
        return (self.prefix_ids, 0) if text.startswith(" ") else (self.word_ids(words[0], self.prefix), 1)

    def encode(self, text: str, memo: dict | None = None) -> list[int]:
        words = self.split(text)
        log.debug("%d words in a text of %d characters, pattern %s", len(words), len(text), self.pattern)
        memo = {} if memo is None else memo
        ids, used = self.head(text, words)
        out = list(ids)
        for word in words[used:]:
            ids = memo.get(word)
            if ids is None:
                if len(memo) > 500_000:
                    memo.clear()
                memo[word] = ids = self.word_ids(word)
            out += ids
        return out

    def decode_bytes(self, ids) -> bytes:
        if isinstance(ids, (str, bytes)) or not hasattr(ids, "__iter__"):
            raise TypeError("Argument must be a list of integers")
        ids = list(ids)
        table = self.bytes_of
        try:
            if table is not None and not (self.prefix and self._starts_with_prefix(ids)):
                return b"".join(map(table.__getitem__, ids))
            mapped = b"".join([self.tokens[i] for i in ids])
        except (KeyError, TypeError):
            raise ValueError(OUT_OF_RANGE) from None
        return mapped if not self.special and not self.byte_mode and not self.prefix else self.detokenize(mapped.decode())

    def _starts_with_prefix(self, ids: list[int]) -> bool:
        head, want = b"", self.prefix.encode()
        for i in ids:
            head += self.tokens[i]
            if len(head) >= len(want):
                break
        return head.startswith(want)

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode()

    def batch_encode(self, texts: list[str]) -> list[list[int]]:
        if not isinstance(texts, list):
            raise TypeError("Input must be a list of strings.")
        memo: dict = {}
        return [self.encode(t, memo) for t in texts]

    def batch_decode(self, batch: list[list[int]]) -> list[str]:
        if not batch:
            raise ValueError("No tokens provided.")
        if not all(isinstance(x, list) for x in batch):
            raise TypeError("Each element must be a list of token ids.")
        return [self.decode(x) for x in batch]


# What stands for bracket classes, in patterns for Python and Java.
_CLASSES = {"alpha": "A-Za-z" + LETTERS, "digit": "0-9", "alnum": "A-Za-z0-9" + LETTERS, "space": r" \t\n\x0B\f\r", "upper": "A-Z", "lower": "a-z", "punct": r"!-/:-@\[-`{-~"}


def java_classes(pattern: str) -> str:
    """POSIX bracket classes in a pattern as what Python and Java know; Java takes alternatives leftmost-first."""
    for name, chars in _CLASSES.items():
        pattern = pattern.replace(f"[:{name}:]", chars)
    return pattern


def longest_matches(pattern: str):
    """A user's pattern, of whose matches at a place the longest counts, whatever the order of its alternatives."""
    try:
        return regex.compile(java_classes(pattern), regex.POSIX)
    except regex.error as e:
        raise ValueError("Regex could not be compiled.") from e


# --- the text files, one line at a time; sources.files has the same for tables


def parse_vocab_line(line: str) -> tuple[bytes, int]:
    left, sep, right = line.partition(" == ")
    number = re.match(r"\s*([+-]?[0-9]+)", right)
    if not sep:
        raise ValueError(BAD_VOCAB)
    if not number:
        raise ValueError("Invalid format in vocab file, could not parse integer value.")
    value = int(number[1])
    if not -(2**31) <= value < 2**31:
        raise ValueError("Integer value in vocab file is out of range.")
    return bytes(int(x, 16) for x in re.findall(r"0x([0-9a-fA-F]{2})", left)), value


def format_vocab_line(token: bytes, id_: int) -> str:
    return "".join(f"0x{b:02X}" for b in token) + f" == {id_}"


def load_vocab(lines) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for line in lines:
        token, id_ = parse_vocab_line(line.rstrip("\n"))
        if token in out:
            raise ValueError(f"Token {token!r} occurs twice in the vocab file.")
        out[token] = id_
    if not out:
        raise ValueError("Vocab file is empty.")
    if len(set(out.values())) < len(out):
        raise ValueError("A token id occurs twice in the vocab file.")
    return out


def load_special(lines) -> dict[int, str]:
    out = {}
    for line in lines:
        left, sep, right = line.rstrip("\n").partition(" == ")
        if not sep or not left.strip().isdigit() or int(left) > 255:
            raise ValueError("Invalid format in special character file.")
        if not right:
            raise ValueError("Value is empty in special character file.")
        out[int(left)] = right
    return out


def load_merges(lines, vocab: dict[bytes, int], skip_all_hashes: bool = False) -> dict[tuple[int, int], tuple[int, int]] | None:
    """Rules whose sides and result are tokens, ranked among themselves; None if no rule is left.

    A first line of "#version" is left out; skip_all_hashes leaves out every line that starts with "#".
    """
    out: dict[tuple[int, int], tuple[int, int]] = {}
    rank = 0
    for i, line in enumerate(lines):
        if line.startswith("#") and (skip_all_hashes or (i == 0 and line.startswith("#version"))):
            continue
        parts = line.rstrip("\n").split(" ")
        if len(parts) < 2:
            continue
        left, right = parts[0].encode(), parts[1].encode()
        if left in vocab and right in vocab and left + right in vocab:
            out[vocab[left], vocab[right]] = (rank, vocab[left + right])
            rank += 1
    return out or None


def _lines(path) -> list[str]:
    with open(path, encoding="utf-8", newline="\n") as f:
        return f.read().removesuffix("\n").split("\n")


def load_model(vocab_path: str, special_path: str | None = None, merges_path: str | None = None, **kw) -> TokenizerModel:
    """A model from local files (a tokenizer's vocabulary is small; tables of any size go through sources.files)."""
    vocab = load_vocab(_lines(vocab_path))
    special = load_special(_lines(special_path)) if special_path else {}
    log.debug("vocab of %d tokens from %s, %d special characters", len(vocab), vocab_path, len(special))
    return TokenizerModel(vocab, special, load_merges(_lines(merges_path), vocab) if merges_path else None, **kw)


def load_folder(path: str, **kw) -> TokenizerModel:
    """A model from the folder that a tokenizer was exported to, named <name>.

    Vocabulary: <name>.txt in vocabulary lines, else vocab.json, else the model of tokenizer.json with its added tokens.
    Merge rules: merges.txt, else those of tokenizer.json; without any, merging goes by ids. Special characters:
    <name>_special_chars.txt, else the byte alphabet for byte-level vocabularies, else what tokenizer.json makes of each
    such character, for which the tokenizers library must be there. Prefix: see infer_prefix.
    """
    folder = Path(path)
    whole = json.loads((folder / "tokenizer.json").read_text("utf-8")) if (folder / "tokenizer.json").is_file() else {}
    own = whole.get("model", {})
    if (lines := folder / f"{folder.name}.txt").is_file():
        vocab = load_vocab(_lines(lines))
    elif (mapping := folder / "vocab.json").is_file():
        vocab = {k.encode(): v for k, v in json.loads(mapping.read_text("utf-8")).items()}
    elif isinstance(own.get("vocab"), dict):
        vocab = {k.encode(): v for k, v in own["vocab"].items()} | {x["content"].encode(): x["id"] for x in whole.get("added_tokens", ())}
    else:
        raise ValueError(f"No vocab in the folder '{path}'.")
    if (rules := folder / "merges.txt").is_file():
        merges = load_merges(_lines(rules), vocab)
    else:
        merges = load_merges([x if isinstance(x, str) else " ".join(x) for x in own.get("merges", ())], vocab)
        if merges is None:
            log.debug("no merge rules in %s", path)
    alphabet = byte_alphabet()
    byte_mode = all(c.encode() in vocab for c in alphabet.values())
    try:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(str(folder / "tokenizer.json")) if whole else None
    except ImportError:
        tokenizer = None
    if (lines := folder / f"{folder.name}_special_chars.txt").is_file():
        special = load_special(_lines(lines))
    elif byte_mode:
        special = special_bytes()
    else:
        made = {b: "".join(tokenizer.encode(chr(b), add_special_tokens=False).tokens) for b in special_bytes()} if tokenizer else {}
        special = {b: x for b, x in made.items() if x and x != chr(b)}
    kw.setdefault("byte_mode", byte_mode)
    if "prefix" not in kw:
        first = tokenizer.encode("hu", add_special_tokens=False).tokens[:1] if tokenizer else None
        kw["prefix"] = infer_prefix(first[0]) if first else None
    return TokenizerModel(vocab, special, merges, **kw)


def infer_prefix(token: str) -> str | None:
    """What a tokenizer puts before a text, from its first token of "hu": that token's first character, unless it is "hu"."""
    return token[0] if token != "hu" else None


def convert_json_vocab(mapping: dict) -> list[str]:
    """Vocabulary lines of a JSON vocabulary: ids are places in the key order."""
    return [format_vocab_line(k.encode(), i) for i, k in enumerate(mapping)]
