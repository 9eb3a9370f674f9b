"""Hashed character n-grams of whole texts, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

from . import textscan

#: Bytes of text whose n-grams are made together.
SLICE_BYTES = 1 << 20
#: Code points below this are lower-cased and looked up in a table; those above that are letters stay as they are.
_TABLE = 0x3000
_FOLD = np.full(_TABLE, 32, np.uint32)
_LETTER = np.zeros(_TABLE, bool)
for _c in range(_TABLE):
    if chr(_c).isalpha():
        _LETTER[_c] = True
        _FOLD[_c] = ord(chr(_c).lower()) if len(chr(_c).lower()) == 1 else _c


@cache
def _high_letters() -> np.ndarray:
    """Which code points from _TABLE up are letters; made once a process, when a text first holds such a point."""
    return np.fromiter((chr(c).isalpha() for c in range(_TABLE, 0x110000)), bool, 0x110000 - _TABLE)


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded code points, which are letters, offsets in code points); all but letters fold to a space."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    at = heads[offsets]
    low = points < _TABLE
    small = np.where(low, points, 0)
    letters = np.where(low, _LETTER[small], False)
    folded = np.where(low, _FOLD[small], 32).astype(np.uint32)
    high = np.flatnonzero(~low)
    if len(high):
        high = high[_high_letters()[points[high] - _TABLE]]
        letters[high], folded[high] = True, points[high]
    return folded, letters, at


def hashed(column, orders: tuple[int, ...], buckets: int, letters: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, n-gram buckets, text of each n-gram less the first) for runs of texts.

    n-grams stay inside a text; runs of characters that are no letters count as one space. ``letters``, if given,
    is set where a text has a letter. ``buckets`` is a power of two.
    """
    shift = np.uint64(64 - buckets.bit_length() + 1)
    for i, j, data, offsets in textscan.slices(column, SLICE_BYTES):
        folded, letter, at = codes(data, offsets)
        owner = np.repeat(np.arange(j - i), np.diff(at))
        if letters is not None:
            letters[i:j] = np.bincount(owner[letter], minlength=j - i) > 0
        # Of a run of spaces inside a text only the first stays.
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[at[:-1][at[:-1] < len(keep)]] = True
        folded, owner = folded[keep].astype(np.uint64), owner[keep]
        grams, of = [], []
        for order in orders:
            n = len(folded) - order + 1
            if n <= 0:
                continue
            total = np.full(n, order, np.uint64)
            for k in range(order):
                total = total * np.uint64(0x100000001B3 * 2654435761 % (1 << 64) | 1) + folded[k : k + n]
            inside = owner[:n] == owner[order - 1 :]
            total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            grams.append((total[inside] >> shift).astype(np.int64))
            of.append(owner[:n][inside])
        if grams:
            yield i, j, np.concatenate(grams), np.concatenate(of)
