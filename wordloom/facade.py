"""The tokenizer of this process: initialize once, then encode and decode texts or lists of them.

For columns, see operators.bpe; model() gives what they take.
"""

from __future__ import annotations

import os

from .model import TokenizerModel, initialize_logging, load_folder, load_model

_current: list[TokenizerModel] = []


def initialize(model_or_path: str, special_chars_file: str | None = None, *, merges_file: str | None = None, prefix: str | None = None, is_byte_encoder: bool = False, token_id: int = -1, pattern: str | None = None) -> TokenizerModel:
    """Loads a vocabulary file, with its special characters and merge rules, or the folder of an exported tokenizer.

    token_id is accepted and not used. A model hub is not asked: its tokenizers must have been exported to a folder.
    """
    initialize_logging()
    if os.path.isfile(model_or_path):
        for what, path in (("Special characters", special_chars_file), ("The provided merges", merges_file)):
            if path and not os.path.isfile(path):
                raise ValueError(f"{what} file '{path}' does not exist.")
        made = load_model(model_or_path, special_chars_file, merges_file, prefix=prefix, byte_mode=bool(is_byte_encoder), pattern=pattern)
    elif os.path.isdir(model_or_path):
        given = {"prefix": prefix} if prefix is not None else {}
        made = load_folder(model_or_path, pattern=pattern, **given, **({"byte_mode": True} if is_byte_encoder else {}))
    else:
        raise ValueError(f"There is no vocab file or folder '{model_or_path}'.")
    made.words  # a pattern that cannot be compiled is told of here
    _current[:] = [made]
    return made


def model() -> TokenizerModel:
    if not _current:
        raise RuntimeError("No tokenizer yet: call initialize first.")
    return _current[0]


def encode(text: str) -> list[int]:
    return _wrapped("encoding text", lambda: model().encode(text))


def batch_encode(texts: list[str], num_threads: int = 1) -> list[list[int]]:
    """num_threads is accepted: many texts are encoded in parallel as a column."""
    return _wrapped("encoding texts", lambda: model().batch_encode(texts))


def decode(tokens: list[int]) -> str:
    try:
        return _wrapped("decoding tokens", lambda: model().decode(tokens), keep=ValueError)
    except ValueError as e:
        raise ValueError(f"Error decoding tokens {tokens}: {e}") from e


def batch_decode(tokens: list[list[int]], num_threads: int = 1) -> list[str]:
    return _wrapped("decoding tokens", lambda: model().batch_decode(tokens))


def _wrapped(what: str, run, keep: tuple | type = ()):
    try:
        return run()
    except keep:
        raise
    except Exception as e:
        raise RuntimeError(f"Error {what}: {e}") from e
