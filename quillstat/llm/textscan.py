"""Vectorised scanning of whole texts in Arrow batches: word bounds, word hashes and rolling window hashes.

Everything works on the UTF-8 bytes of many texts at once, so the cost per byte is a few numpy operations and no
Python object is made per word. Words are runs of bytes other than 0x20 and 0x09-0x0D; no UTF-8 sequence holds these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text scanned together; a longer text is scanned alone.
SLICE_BYTES = 3 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = x + np.uint64((0x632BE59BD9B4E019 * (salt + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)
_BYTE_LOWER = _BYTE[_LOWER]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, min((-(-(n - 2) >> 20) << 20) + 2, SLICE_BYTES + 2))  # in steps of 1 MB: callers' slices differ
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets between them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(column, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, bytes, offsets from 0) of runs of texts of about ``most`` bytes together."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slice with its case folded by Unicode (bytes that are no UTF-8 stay); its words stay the same in number."""
    if not len(data) or data.max() < 0x80:
        return _LOWER[data], offsets
    # Folding may change a letter's length, so texts are folded one by one.
    whole, at = data.tobytes(), offsets.tolist()
    texts = [whole[a:b].decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape") for a, b in zip(at[:-1], at[1:], strict=True)]
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


class Words:
    """Words of a slice: byte bounds ``starts``/``ends``, and ``first``[k]..``first``[k+1] are those of text k."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        word = ~_WS[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty_like(word)
        before[:1], before[1:] = False, word[:-1]
        before &= ~edge[:-1]
        after = np.empty_like(word)
        after[-1:], after[:-1] = False, word[1:]
        after &= ~edge[1:]
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial in its bytes, mixed."""
        n = len(self.data) + 1
        up, down = _powers(n)
        total = np.zeros(n, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[self.data] * up[:-1], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def joined(self, k: int) -> bytes:
        """The words of text k joined by one space."""
        a, b = self.first[k], self.first[k + 1]
        return join_words(self.data, self.starts[a:b], self.ends[a:b])


def join_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words of ``data`` joined by one space, without a Python loop."""
    if not len(starts):
        return b""
    # Runs of words that are a single space apart already are copied in one piece.
    near = (starts[1:] - ends[:-1] == 1) & (data[np.minimum(ends[:-1], len(data) - 1)] == 0x20)
    cut = np.flatnonzero(~near)
    a, b = starts[np.concatenate(([0], cut + 1))], ends[np.concatenate((cut, [len(ends) - 1]))]
    view = data.tobytes() if len(a) > 64 else data
    if isinstance(view, bytes):
        return b" ".join([view[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    return b" ".join([view[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)])


def windows(words: np.ndarray, first: np.ndarray, width: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of ``width`` words inside one text: Rabin-Karp over word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    base, total = np.uint64(0xD1342543DE82EF95 + 2 * salt), np.zeros(n, np.uint64)
    for k in range(width):
        total = total * base + words[k : k + n]
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)
    at = np.flatnonzero(left >= width)
    return at, mix(total[at], salt)


def owners(first: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
