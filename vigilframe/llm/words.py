"""Words of many texts at once, as hashes in numpy arrays.

Words are runs of bytes other than ASCII white space (0x20, 0x09 to 0x0D), with A-Z
in lower case, as ``bytes.lower`` and ``bytes.split`` see them.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Everything in ASCII but letters and digits, for words without punctuation.
_MARKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[bytes], marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, in order, and the number of words of each text.

    With ``marks``, ASCII punctuation separates words as white space does.

    Keep groups of texts near one megabyte (``text_groups``): about 40 bytes of
    working memory are used per byte of text.
    """
    data = np.frombuffer((b"\n".join(texts) + b"\n").lower(), np.uint8)
    solid = ~(_MARKS if marks else _SPACE)[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    starts = np.flatnonzero(first)
    text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    counts = np.diff(np.searchsorted(starts, text_ends), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    place = np.flatnonzero(solid)
    offsets = np.searchsorted(place, starts)
    lengths = np.diff(np.append(offsets, len(place)))
    powers = np.full(int(lengths.max()), _BASE)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    letters = data[place].astype(np.uint64) + np.uint64(1)
    letters *= powers[place - np.repeat(starts, lengths)]
    return mix(np.add.reduceat(letters, offsets)), counts
