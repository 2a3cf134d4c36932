"""Native column functions: word splitting, character classes, byte mapping. Python runs on executors for patterns with alternatives alone."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import LETTERS, WORD_PATTERN, TokenizerModel, java_classes, longest_matches


def split_words(text: Column, pattern: str | None = None) -> Column:
    """The words of a text, or the matches of a pattern, the longest at each place; null for null.

    Java takes the first alternative that matches instead of the longest, so patterns with alternatives go to Python.
    """
    if pattern is not None and "|" in pattern:
        return _longest(pattern)(text)
    return F.filter(F.regexp_extract_all(text, F.lit(WORD_PATTERN if pattern is None else java_classes(pattern)), F.lit(0)), lambda x: x != "")


def _longest(pattern: str):
    longest_matches(pattern)  # a wrong pattern is told of here

    def run(texts: pa.Array) -> pa.Array:
        matches = longest_matches(pattern).finditer
        return pa.array([None if t is None else [x for m in matches(t) if (x := m.group())] for t in texts.to_pylist()], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")


def class_counts(text: Column) -> dict[str, Column]:
    """Numbers of characters by class."""
    classes = {"alpha": f"[A-Za-z{LETTERS}]", "digit": "[0-9]", "space": r"[ \t\n\x0B\f\r]"}
    out = {k: F.regexp_count(text, F.lit(v)) for k, v in classes.items()}
    out["other"] = F.length(text) - out["alpha"] - out["digit"] - out["space"]
    return out


def utf8_lengths(text: Column) -> dict[str, Column]:
    """Numbers of characters of one to four bytes."""
    n, two, three = F.length(text), F.regexp_count(text, F.lit(r"[\x{80}-\x{7FF}]")), F.regexp_count(text, F.lit(r"[\x{800}-\x{FFFF}]"))
    four = F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    return {"len1": n - two - three - four, "len2": two, "len3": three, "len4": four}


def pretokenize(text: Column, model: TokenizerModel, prefix: str | None = None) -> Column:
    """The text in a model's alphabet."""
    if model.byte_mode and all(len(v) == 1 for v in model.special.values()):
        latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
        out = F.translate(latin, "".join(map(chr, model.special)), "".join(model.special.values())) if model.special else latin
    else:
        source = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1") if model.byte_mode else text
        key = F.ascii if model.byte_mode else (lambda c: F.conv(F.substring(F.hex(F.encode(c, "UTF-8")), 1, 2), 16, 10).cast("int"))
        if model.special:
            map_ = F.create_map(*[F.lit(x) for b, v in model.special.items() for x in (b, v)])
            out = F.array_join(F.transform(F.regexp_extract_all(source, F.lit(r"[\s\S]"), F.lit(0)), lambda c: F.coalesce(F.try_element_at(map_, key(c)), c)), "")
        else:
            out = source
    return F.concat(F.lit(prefix), out) if prefix else out


def detokenize(text: Column, model: TokenizerModel) -> Column:
    """Back to text: prefix off, longest replacements first; null where the bytes are no UTF-8."""
    if model.prefix:
        text = F.when(F.startswith(text, F.lit(model.prefix)), F.substring(text, len(model.prefix) + 1, 2**31 - 1)).otherwise(text)
    longest = sorted(model.reverse, key=len, reverse=True)
    units = F.regexp_extract_all(text, F.lit("|".join([*map(re.escape, longest), r"[\s\S]"])), F.lit(0))
    known = F.create_map(*[F.lit(x) for v, b in model.reverse.items() for x in (v, f"{b:02X}")]) if model.reverse else None
    own = lambda c: F.when(F.ascii(c) < 256, F.lpad(F.hex(F.ascii(c)), 2, "0")).otherwise(F.lit("3F")) if model.byte_mode else F.hex(F.encode(c, "UTF-8"))
    hexed = F.transform(units, lambda c: F.coalesce(F.try_element_at(known, c), own(c)) if known is not None else own(c))
    return F.try_validate_utf8(F.unhex(F.array_join(hexed, "")).cast("string"))


def chunk_spans(text: Column, size: int | Column) -> Column:
    """A text in chunks of `size` characters, each extended to the next blank, line end or tab."""
    if isinstance(size, int):
        return F.regexp_extract_all(text, F.lit(rf"[\s\S]{{1,{size}}}[^ \n\t]*[ \n\t]?"), F.lit(0))
    pattern = F.concat(F.lit(r"[\s\S]{1,"), size.cast("string"), F.lit(r"}[^ \n\t]*[ \n\t]?"))
    return F.regexp_extract_all(text, pattern, F.lit(0))


def chunk_parts(text: Column, parts: int) -> Column:
    """A text in about `parts` chunks of equal length."""
    return chunk_spans(text, F.greatest(F.lit(1), F.ceil(F.length(text) / parts)).cast("int"))
