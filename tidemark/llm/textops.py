"""Words of whole Arrow text columns as numpy arrays: one pass over bytes, no loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text is handled in slices of about this many bytes (a longer text is a slice of its own).
SLICE_BYTES = 1 << 19
U = np.uint64


def byte_class(spec: str) -> np.ndarray:
    """'space': all but 0x20 and 0x09-0x0D. 'alnum': digits, letters a-z and every byte of a non-ASCII character."""
    ok = np.zeros(256, bool)
    if spec == "space":
        ok[:] = True
        ok[[32, *range(9, 14)]] = False
    else:
        ok[48:58] = ok[97:123] = ok[128:] = True
    return ok


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16) * 5 // 4, base, np.uint64)
        step[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """data: bytes; start, end: of each word; doc: its text's place; first: a text's first word, with one more at the end."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self):
            return np.zeros(0, np.uint64)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _powers(_BASE, len(self.data)), out=total[1:])
        back = _powers(pow(_BASE, -1, 2**64), len(self.data))
        return mix((total[self.end] - total[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64))

    def joined(self, gap: int = 32) -> Words:
        """The same words with exactly one space (or another byte) between neighbours."""
        size = self.end - self.start
        new_end = np.cumsum(size + 1) - 1
        new_start = new_end - size
        out = np.full(int(new_end[-1]) + 1 if len(self) else 0, gap, np.uint8)
        if len(self):
            mark = np.zeros(len(self.data) + 1, np.int8)
            mark[self.start] += 1
            mark[self.end] -= 1
            inside = np.cumsum(mark[:-1]).astype(bool)
            # adjacent words without a gap cannot occur inside one text; between texts they can
            seat = np.repeat(new_start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
            out[seat] = self.data[inside]
        return Words(out, new_start, new_end, self.doc, self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n neighbouring hashes; texts are told apart by the caller."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= U(0xD6E8FEB86659FD93)
        out += h[j : len(h) - n + 1 + j]
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w neighbours."""
    width, out = 1, x
    while width < w:
        step = min(width, w - width)
        if len(out) <= step:
            return out[:0]
        out = np.minimum(out[:-step], out[step:])
        width += step
    return out


def give_back() -> None:
    """Freed memory goes back to the system: Python workers are kept between tasks and would hold it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of neighbouring rows, about SLICE_BYTES each. Null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + SLICE_BYTES, "right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b
    give_back()


def split_words(data: np.ndarray, off: np.ndarray, inside: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    is_word = inside[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    cut = off[(off > 0) & (off < n)]
    before[cut] = False
    after[cut - 1] = False
    start = np.flatnonzero(is_word & ~before)
    end = np.flatnonzero(is_word & ~after) + 1
    first = np.searchsorted(start, off)
    return Words(data, start, end, np.repeat(np.arange(len(off) - 1), np.diff(first)), first)
