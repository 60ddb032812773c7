"""Vectorised word spans and rolling hashes over Arrow string batches.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; as UTF-8 never uses those bytes inside a
longer character, this is the pattern ``[^\\x20\\x09-\\x0D]+`` over code points. Everything works on one
contiguous byte buffer for many texts, so the cost per text is a few numpy passes and no Python loop.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of a hash can be used for ordering or bucketing."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=_U)
_STEP = _U(0xD6E8FEB86659FD93)
#: Longer spans are hashed one by one.
_LONG = 256


def hash_bytes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of every byte span.

    Spans of up to eight bytes are one number, which is mixed bijectively; of longer ones, eight bytes at a time go through two
    different chains of mixing, which are joined at the end. Spans of more than ``_LONG`` bytes are hashed with BLAKE2. There
    is no sum of powers here: modulo 2**64 such sums agree for some long words whatever the base is.
    """
    size = end - start
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))
    own = mix(np.array([seed * _GOLD & (2**64 - 1), (seed + 1) * _GOLD & (2**64 - 1)], _U))
    head = eight[start] & _MASK[np.minimum(size, 8)]
    out = mix(head ^ own[0])
    more = np.flatnonzero((size > 8) & (size <= _LONG))
    if len(more):
        a, b = out[more], mix(head[more] * _STEP + own[1])
        at, left, live = start[more] + 8, size[more] - 8, np.arange(len(more))
        while len(live):
            part = eight[at[live]] & _MASK[np.minimum(left[live], 8)]
            a[live], b[live] = mix(a[live] ^ part), mix(b[live] * _STEP + part)
            at[live] += 8
            left[live] -= 8
            live = live[left[live] > 0]
        out[more] = a + mix(b ^ own[0])
    for i in np.flatnonzero(size > _LONG):
        key = seed.to_bytes(8, "little")
        out[i] = int.from_bytes(hashlib.blake2b(padded[start[i] : end[i]].data, digest_size=8, key=key).digest(), "little")
    return mix(out + size.astype(_U) * _U(_GOLD))


class Rolling:
    """Hashes of short spans of a sequence of well mixed numbers as differences of prefix sums modulo 2**64.

    ``base`` is odd, so its powers have inverses and a span's hash does not depend on where it lies.
    """

    def __init__(self, seed: int):
        base = (int(mix(np.array([seed * _GOLD & (2**64 - 1)], dtype=_U))[0]) & ~7 | 5) & (2**64 - 1)
        self.seed, self.base, self.inverse = seed, _U(base), _U(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, dtype=_U)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, b, dtype=_U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of ``values[start:end]`` for every span; values are 64-bit."""
        n = len(values)
        self._powers(n + 1)
        total = np.zeros(n + 1, dtype=_U)
        np.cumsum(values * self.up[:n], out=total[1:])
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(_U) * _U(_GOLD))

    def of_bytes(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return hash_bytes(buf, start, end, self.seed)


FIRST, SECOND, THIRD = Rolling(11), Rolling(23), Rolling(47)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, off - off[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``limit`` bytes of text (a longer text stays whole)."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
    yield from _cut(batch, np.diff(utf8(column)[1]), limit)


def parts(batch: pa.RecordBatch, names: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The same by the bytes of all binary columns ``names`` (a letter each)."""
    sizes = [pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(c))), 0).to_numpy(zero_copy_only=False) for c in names]
    yield from _cut(batch, sum(x.astype(np.int64) for x in sizes), limit)


def _cut(batch: pa.RecordBatch, size: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    part = np.cumsum(size) // limit
    edge = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
    for a, b in zip(edge, edge[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def trim() -> None:
    """Give freed memory back, so that idle workers of an executor stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Words:
    """Word spans of many texts: ``start``, ``end`` in ``buf`` and ``first``: each text's range of words."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, lower: bool = False):
        self.buf = _LOWER[buf] if lower else buf
        word = _IS_WORD[buf]
        before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        inside = off[(off > 0) & (off < len(buf))]
        before[inside], after[inside - 1] = False, False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)

    def hashes(self, rolling: Rolling = FIRST) -> np.ndarray:
        return rolling.of_bytes(self.buf, self.start, self.end)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, last word + 1 and text of every window of ``k`` words; ``short``: a text of fewer words is one window."""
        n = np.maximum(self.count - k + 1, 0)
        if short:
            n = np.where((n == 0) & (self.count > 0), 1, n)
        text = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + self.first[:-1][text]
        return at, np.minimum(at + k, self.first[1:][text]), text


def shingles(words: Words, k: int = 5, rolling: Rolling = FIRST) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct ``k``-word shingle, ordered by text and hash."""
    a, b, text = words.windows(k, short=True)
    h = SECOND.spans(words.hashes(rolling), a, b)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[new], h[new]
