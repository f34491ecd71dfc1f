"""Word shingles of texts as 64-bit hashes, a batch at a time."""
from __future__ import annotations

import numpy as np
import xxhash

from .common import LOWER, UPPER, Words

SHINGLE = 5
_TO_LOWER = str.maketrans(UPPER, LOWER)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def lower(word: str) -> str:
    """A-Z only."""
    return word.lower() if word.isascii() else word.translate(_TO_LOWER)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order, repeats included, and the offsets of the texts. A text of fewer than
    ``width`` words, but at least one, is one shingle."""
    of_word = np.fromiter((xxhash.xxh3_64_intdigest(lower(w)) for w in words.vocab), "uint64", len(words.vocab))
    h = of_word[words.codes] if len(words.codes) else np.empty(0, "uint64")
    lengths = np.diff(words.offsets)
    windows = h.copy()
    ahead = np.zeros(len(h), "int64")  # words of the text from here on
    owner = np.repeat(np.arange(len(lengths)), lengths)
    ahead = words.offsets[1:][owner] - np.arange(len(h))
    for k in range(1, width):
        nxt = np.zeros_like(h)
        nxt[:-k or None] = h[k:] if k < len(h) else 0
        # Past the end nothing is added, so a short text hashes as what it has.
        windows = np.where(ahead > k, mix(windows) + nxt, windows)
    starts = np.arange(len(h)) == words.offsets[:-1][owner]
    kept = (ahead >= width) | (starts & (lengths[owner] < width))
    return mix(windows[kept]), np.concatenate([[0], np.cumsum(np.bincount(owner[kept], minlength=len(lengths)))]).astype("int64")
