"""Sets of word n-grams as sorted 64-bit hashes, made a batch of texts at a time.

A word's hash is a polynomial over its bytes modulo 2^64, so the hashes of all words of a batch
come from one running sum; an n-gram's hash is a mix of its words' hashes. Texts are taken in
pieces of about ``PIECE`` bytes, so working memory doesn't grow with a text, only its set does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

WORDS = 5
PIECE = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_BLANKS = b" \t\n\x0b\x0c\r"
_IS_BLANK = np.isin(np.arange(256), list(_BLANKS))
_NEXT_BLANK = re.compile(b"[" + re.escape(_BLANKS) + b"]")


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _byte_values(fold: bool) -> np.ndarray:
    """A random number for each byte; if ``fold``, A-Z have those of a-z."""
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32 * fold)
    return finish((lower + np.uint64(1)) * _ODD[1])


_VALUE, AS_THEY_ARE = _byte_values(True), _byte_values(False)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, up to n at least."""
    size = max(1 << 12, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        rise, fall = np.full(size, _BASE, np.uint64), np.full(size, _BACK, np.uint64)
        rise[0] = fall[0] = 1
        _POWERS[size] = np.cumprod(rise, dtype=np.uint64), np.cumprod(fall, dtype=np.uint64)
    return _POWERS[size]


def words_in(raw: bytes, value: np.ndarray = _VALUE) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a run of bytes begin, and their hashes."""
    d = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(_IS_BLANK[d], prepend=True, append=True))
    begin, end = edge[::2], edge[1::2]
    rise, fall = powers(len(d))
    sums = np.zeros(len(d) + 1, np.uint64)
    np.cumsum(value[d] * rise[: len(d)], out=sums[1:])
    return begin, finish((sums[end] - sums[begin]) * fall[begin])


def _giant(word: bytes, value: np.ndarray) -> np.ndarray:
    """The hash of a word that is longer than a piece."""
    total = 0
    for at in range(0, len(word), PIECE):
        d = np.frombuffer(word[at : at + PIECE], np.uint8)
        total += int((value[d] * powers(len(d))[0][: len(d)]).sum(dtype=np.uint64)) * pow(_BASE, at, 1 << 64)
    return finish(np.array([total & (2**64 - 1)], np.uint64))


def word_hashes(raw: bytes, value: np.ndarray = _VALUE) -> np.ndarray:
    """The hashes of a text's words, piece by piece; pieces end at white space."""
    found, at = [], 0
    while at < len(raw):
        cut = _NEXT_BLANK.search(raw, min(len(raw), at + PIECE))
        end = cut.start() if cut else len(raw)
        piece = raw[at:end]
        found += [words_in(piece, value)[1]] if len(piece) <= 2 * PIECE else [_giant(w, value) if len(w) > PIECE else words_in(w, value)[1] for w in piece.split()]
        at = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def _sorted_distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    h = np.full(max(0, len(words) - k + 1), k, np.uint64)
    for i in range(k):
        h += words[i : i + len(h)] * _ODD[i]
    return finish(h)


def _set_of(words: np.ndarray) -> np.ndarray:
    return _sorted_distinct(_grams(words, min(WORDS, len(words)))) if len(words) else words


def ngram_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """For each text its sorted distinct n-gram hashes; that of its whole sequence if it is shorter."""
    held: list[bytes] = []

    def together() -> Iterator[np.ndarray]:
        begin, words = words_in(b" ".join(held)) if held else (np.empty(0, np.int64), np.empty(0, np.uint64))
        grams = _grams(words, WORDS)
        stop = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in held]))
        low = 0
        for high in stop.tolist():
            yield _sorted_distinct(grams[low : high - WORDS + 1]) if high - low >= WORDS else _set_of(words[low:high])
            low = high
        held.clear()

    size = 0
    for text in texts:
        text = text or b""
        if size + len(text) > PIECE:
            yield from together()
            size = 0
        if len(text) > PIECE:
            yield _set_of(word_hashes(text))
        else:
            held.append(text)
            size += len(text) + 1
    yield from together()
