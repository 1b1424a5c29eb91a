"""Words and word shingles of whole texts as 64-bit hashes, for batches of texts in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words in a shingle.
WIDTH = 5
_P = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values with all bits stirred (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word, worked out once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def words(text: str | None) -> list[bytes]:
    """The runs of characters other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode("utf-8", "replace").split() if text else []


def word_hashes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, flat, and where each text begins (one more than texts)."""
    get = WordHashes().__getitem__
    ends = np.cumsum([0, *map(len, texts)])
    return np.fromiter((get(w) for t in texts for w in t), np.uint64, int(ends[-1])), ends


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` words in a row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * _P + hashes[i : i + n]
    return mixed(out)


def shingle_sets(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text. Under ``WIDTH`` words, the whole text is one shingle; without words, none."""
    flat, ends = word_hashes(texts)
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        h = flat[a:b]
        out.append(np.unique(gram_hashes(h, min(WIDTH, len(h)))) if len(h) else h)
    return out
