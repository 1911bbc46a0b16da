"""Word hashes and shingle sets, vectorised over a whole text."""

from __future__ import annotations

import numpy as np

from .common import SPACES

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.array([chr(b) not in SPACES for b in range(256)])
#: Places in a word that have table rows of their own; later places are mixed one by one.
_PLACES = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits."""
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


_table = mix(np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """64-bit hash of every word, in order; A-Z count as a-z."""
    return word_spans(text.translate(_LOWER) if lower else text)[2]


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word. A hash is the sum of random values for each byte at its place in the word."""
    flat = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(flat) + 2, np.bool_)
    inside[1:-1] = _IS_WORD[flat]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    lengths = ends - starts
    letters = flat[inside[1:-1]]
    begins = np.cumsum(lengths) - lengths
    kind = np.int32 if len(letters) < 1 << 23 else np.int64
    place = np.arange(len(letters), dtype=kind) - np.repeat(begins.astype(kind), lengths)
    code = place << 8 | letters
    if int(lengths.max()) <= _PLACES:
        values = _table[code]
    else:
        far = code >= len(_table)
        values = _table[np.where(far, 0, code)]
        values[far] = mix(code[far].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    return starts, ends, mix(np.add.reduceat(values, begins) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words; of the whole sequence where there are fewer; nothing without words."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[i : n - width + 1 + i]
    return mix(total + np.uint64(width))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The distinct k-word shingles as sorted hashes."""
    return np.unique(window_hashes(word_hashes(text), k))
