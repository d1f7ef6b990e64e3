"""Hashed word n-grams of whole texts, vectorised over the bytes of a batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes handled at once; longer texts go through in pieces that hand on their last word.
PIECE = 1 << 18
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64))
_SPACE, _WORD, _SIGN = 0, 1, 2


def _byte_classes() -> np.ndarray:
    """Space and control bytes, word bytes (letters, digits, anything beyond ASCII), other signs."""
    kind = np.full(256, _SIGN, dtype=np.uint8)
    kind[: ord(" ") + 1] = _SPACE
    for c in range(256):
        if c >= 128 or chr(c).isalnum():
            kind[c] = _WORD
    return kind


_KIND = _byte_classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    """The finishing rounds of a 64-bit hash, so that low bits depend on all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start byte and hash of each word: a run of word bytes, or a run of signs, A-Z lower-cased."""
    kind = _KIND[data]
    change = np.empty(len(data), dtype=bool)
    change[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    starts = np.flatnonzero(change)
    if not len(starts):
        return starts, np.empty(0, dtype=np.uint64)
    at = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    sums = np.add.reduceat(_LOWER[data].astype(np.uint64) * _POWERS[at & 63], starts)
    word = kind[starts] != _SPACE
    return starts[word], _mix(sums[word])


def ngram_buckets(texts: Iterable[bytes], n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every word and every pair of neighbouring words of the texts.

    Short texts share a piece, with a zero byte between them; a text over PIECE bytes is cut after
    a space and the pair across the cut is counted too. Arrays come piece by piece.
    """
    group: list[tuple[int, bytes]] = []
    size = 0
    for number, text in enumerate(texts):
        if len(text) > PIECE:
            yield from _long(number, text, n_buckets)
            continue
        group.append((number, text))
        size += len(text) + 1
        if size > PIECE:
            yield _short(group, n_buckets)
            group, size = [], 0
    if group:
        yield _short(group, n_buckets)


def _pairs(hashes: np.ndarray) -> np.ndarray:
    return _mix(hashes[:-1] * np.uint64(31) + hashes[1:])


def _short(group: list[tuple[int, bytes]], n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\0".join(t for _, t in group), dtype=np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for _, t in group)])[:-1]
    starts, hashes = _words(data)
    owner = np.searchsorted(begins, starts, side="right") - 1
    together = owner[1:] == owner[:-1]
    numbers = np.array([n for n, _ in group])[np.concatenate([owner, owner[1:][together]])]
    grams = np.concatenate([hashes, _pairs(hashes)[together]]) if len(hashes) else hashes
    return numbers, (grams % np.uint64(n_buckets)).astype(np.int64)


def _long(number: int, text: bytes, n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    last = np.empty(0, dtype=np.uint64)
    begin = 0
    while begin < len(text):
        end = min(begin + PIECE, len(text))
        if end < len(text):
            cut = max(text.rfind(b" ", begin, end), text.rfind(b"\n", begin, end))
            end = cut + 1 if cut > begin else end
        _, hashes = _words(np.frombuffer(text[begin:end], dtype=np.uint8))
        chained = np.concatenate([last, hashes])
        grams = np.concatenate([hashes, _pairs(chained)]) if len(hashes) else hashes
        yield np.full(len(grams), number), (grams % np.uint64(n_buckets)).astype(np.int64)
        last = chained[-1:]
        begin = end
