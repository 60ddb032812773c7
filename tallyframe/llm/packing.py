"""Operator 10: packing by Karmarkar-Karp multiway differencing.

A document's ids are cut into pieces of a full sequence and one remainder, which is cut once more if it is longer
than half a sequence; full pieces are sequences of their own. A task deals the remainders of its documents, as they come, into blocks of
``block`` documents (the last one may have fewer), so nothing is shuffled, no block grows with its rows' ids or texts, and a lost task
packs the same again. In a block, every remainder starts as a partial partition of ``k`` windows with one of them filled. The two partitions of largest spread are merged, the fullest
windows of one on the emptiest of the other, until one partition is left: ``k`` nearly equal windows. If a window
exceeds the capacity, ``k`` rises by what is too much and the block starts again.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .pretokens import pre_tokens
from .words import pieces, utf8

CAPACITY = 1024
#: Documents in a block; more makes windows more nearly equal, at a cost that grows with its square.
BLOCK = 1024


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each item and the windows' loads, for ``k`` windows.

    A partial partition keeps only its filled windows, fullest first; each is a node of a forest whose leaves are items.
    """
    n = len(sizes)
    left, right = [-1] * n, [-1] * n
    heap = [(-int(s), i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        both = max(0, len(a) + len(b) - k)
        load = np.concatenate([a[: len(a) - both], a[len(a) - both :] + b[len(b) - both :][::-1], b[: len(b) - both]])
        node = np.concatenate([na, nb[: len(nb) - both]])
        if both:
            fresh = np.arange(len(left), len(left) + both)
            left += na[len(na) - both :].tolist()
            right += nb[len(nb) - both :][::-1].tolist()
            node[len(na) - both : len(na)] = fresh
        order = np.argsort(-load, kind="stable")
        load, node = load[order], node[order]
        spread = int(load[0]) - (int(load[-1]) if len(load) == k else 0)
        heapq.heappush(heap, (-spread, serial, load, node))
        serial += 1
    _, _, load, node = heap[0]
    window = np.zeros(len(left), np.int64)
    window[node] = np.arange(len(node))
    for i in range(len(left) - 1, n - 1, -1):
        window[left[i]] = window[right[i]] = window[i]
    return window[:n], load


def equal_windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A window for each item, none above the capacity, with the window count raised until that holds."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, load = differencing(sizes, k)
        over = int((load > capacity).sum())
        if not over:
            return window
        k = min(len(sizes), k + max(1, min(over // 2, k * (int(load[0]) - capacity) // capacity)))


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def deal(size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece of one block; windows count from 0."""
    window, part, full = np.zeros(len(size), np.int64), np.flatnonzero(size < capacity), np.flatnonzero(size == capacity)
    if len(part):
        window[part] = equal_windows(size[part], capacity)
    window[full] = np.arange(len(full)) + (window[part].max() + 1 if len(part) else 0)
    order = np.argsort(window, kind="stable")
    total = np.cumsum(size[order]) - size[order]
    first = np.flatnonzero(np.diff(window[order], prepend=-1))
    offset = np.empty(len(size), np.int64)
    offset[order] = total - np.repeat(total[first], np.diff([*first, len(order)]))
    return window, offset


def _pack(path: str, capacity: int, block: int, end_id: int):
    def run(batches):
        tokens, base, rows, docs = pre_tokens(path), TaskContext.get().partitionId() << 40, [], 0

        def packed():
            nonlocal base, rows, docs
            columns = [list(c) for c in zip(*rows)]
            window, offset = deal(np.array(columns[2]), capacity)
            out = pa.record_batch([pa.array(c, pa.int64()) for c in (columns[0], columns[1], columns[2], columns[3], columns[4], window + base, offset)], names=_NAMES)
            base, rows, docs = base + int(window.max()) + 1, [], 0
            return out

        for batch in batches:
            for piece in pieces(batch, "text"):
                flat, count = tokens.encode(*utf8(piece.column(1)))
                ends = np.cumsum(count)
                for i, a, b in zip(piece.column(0).to_pylist(), ends - count, ends):
                    own = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                    raw = memoryview(own.tobytes())
                    full, half = len(own) // capacity * capacity, capacity // 2
                    edge = [*range(0, full + 1, capacity), *([full + half] if len(own) - full > half else []), *([len(own)] if len(own) > full else [])]
                    for s, size in zip(edge, np.diff(edge).tolist()):
                        rows.append((i, s, size, zlib.crc32(raw[4 * s : 4 * (s + size)]), len(own)))
                    docs += 1
                    if docs == block or len(rows) >= 8 * block:  # a few very long texts may fill a block with full pieces
                        yield packed()
        if rows:
            yield packed()

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, block: int = BLOCK, end_id: int = 0) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``path`` is the tokenizer's file, readable on every executor. A document has its ids and then ``end_id``, so null and
    empty texts have one id. Every id lies in exactly one piece, pieces of one sequence are laid end to end from 0
    and no sequence is longer than ``capacity``. Every row is a document of its own, repeated rows too; a null id
    is returned as null. ``ids_crc32`` is that of the piece's ids as little-endian unsigned 32-bit numbers.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_pack(path, capacity, block, end_id), ", ".join(f"{n} long" for n in _NAMES))
