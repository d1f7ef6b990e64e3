"""Pre-split words of chunks, and results kept by word."""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable
from typing import Any

from tokenizers import Tokenizer

#: Lower-case letters of Latin-1, then marks: for these the lower case of any library is the same.
PLAIN = re.compile("([a-z\xdf-\xf6\xf8-\xff]+)([.,;:!?]*)")
#: UTF-8 bytes, read as Latin-1, to the byte alphabet: the bytes of letters and marks above ASCII that
#: aren't printable in Latin-1 (0x80-0xA0 and 0xAD) stand from U+0100 on, after the 33 control codes.
_ALPHABET = {b: 0x100 + 33 + b - 0x7F for b in range(0x7F, 0xA1)} | {0xAD: 0x100 + 33 + 34}


def in_alphabet(word: str) -> str:
    """A word's UTF-8 bytes in the byte alphabet."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(_ALPHABET)


class Kept(dict):
    """key -> ``make(key)``, kept for later. When ``limit`` keys are kept, they become the old ones and
    those that had been old go; an old key that is asked for is kept again."""

    def __init__(self, make: Callable[[Any], Any], limit: int, longest: int = 64) -> None:
        super().__init__()
        self._make, self._limit, self._longest = make, limit, longest
        self._old: dict = {}

    def __missing__(self, key: Hashable) -> Any:
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(key) <= self._longest:
            if len(self) >= self._limit:
                self._old = dict(self)
                self.clear()
            self[key] = value
        return value


class PreSplit:
    """A chunk of UTF-8 without ASCII white space -> its words in the byte alphabet, as the library's
    normalizer and pre-tokenizer give them. Letters of Latin-1 with marks behind them, which is most
    chunks, need no Unicode tables."""

    def __init__(self, library: Tokenizer) -> None:
        self._clean, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

    def __call__(self, chunk: bytes) -> list[str]:
        text = chunk.decode()
        plain = PLAIN.fullmatch(text.lower())
        if plain:
            return [in_alphabet(w) for w in plain.groups() if w]
        return [w for w, _ in self._split(self._clean(text))]
