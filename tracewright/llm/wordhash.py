"""Hashes of words, remembered by the Python worker."""

from __future__ import annotations

import unicodedata

import numpy as np

REMEMBERED = 150_000
_STRIP = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
#: ASCII in lower case, with the separators that only str.split() takes for white space as blanks.
_LOWER = bytes(32 if 28 <= c < 32 else c + 32 if 65 <= c < 91 else c for c in range(256))


def folded(word: str) -> bytes:
    """A word without case, compatibility forms (NFKC), white space, invisible characters, and
    punctuation of ASCII and Unicode; accents stay."""
    if not word.isascii():
        plain = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", word).casefold())
        word = "".join(c for c in plain if unicodedata.category(c)[0] not in "PZ" and unicodedata.category(c) != "Cf")
    return word.encode("utf-8", "surrogatepass").translate(_LOWER, _STRIP)


class WordHash(dict):
    """64-bit hash of each word (bytes), or of its folded form (str; 0 if nothing is left of it).
    Forgets all once it holds so many, so its memory is bounded."""

    def __missing__(self, word: bytes | str) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        if isinstance(word, str):
            word, raw = folded(word), word
            value = self[raw] = (xxhash.xxh3_64_intdigest(word) or 1) if word else 0
        else:
            value = self[word] = xxhash.xxh3_64_intdigest(word) or 1
        return value


_SHARED = WordHash()


def word_hashes(words: list[bytes] | list[str]) -> np.ndarray:
    return np.fromiter(map(_SHARED.__getitem__, words), dtype=np.uint64, count=len(words))


def folded_hashes(text: str) -> np.ndarray:
    """The hashes of a text's folded words, between Unicode white space; words without a rest are left out."""
    if text.isascii():
        return word_hashes(text.encode().translate(_LOWER, _STRIP).split())
    found = word_hashes(text.split())
    return found[found != 0]
