"""Operator 4: exact removal of repeated word windows by super-k-mer partitioning.

A window is ``k`` consecutive words of one document. Its minimiser is the smallest hash of the ``m``-word grams in
it. Consecutive windows that share a minimiser form a super-k-mer, which travels once, as one packed string, to
the minimiser's bucket; equal windows have equal minimisers and so always meet there. The bucket cuts the strings
into windows again, sorts them and marks every one that also starts earlier.

Before anything travels, a task sorts the windows of each piece of about 1 MB of its texts: all but the earliest of equal
windows are marked on the spot and only the earliest goes on. A passage that many documents share therefore
reaches its bucket once for each piece, not once for each document.

A count sketch of fixed size first counts the windows of every minimiser. Windows of *hot* minimisers, of which there are more than a
bucket should hold, don't go by minimiser: they are dealt by the hash of the window itself and, as equal ones may still come from
very many pieces, merged twice, first within groups of tasks. Which way a window goes depends on its minimiser alone, so equal ones always
meet. Windows are compared by two independent 64-bit hashes of their words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sketch
from .common import NO_ID, Scratch
from .words import FIRST, SECOND, THIRD, Rolling, Words, mix, pieces, trim, utf8

_U = np.uint64
_GRAM = 3
#: Bytes of super-k-mers that a task holds before it sends blocks, and bytes of them in a bucket.
_HELD, _BUCKET = 32_000_000, 16_000_000
#: Windows of a minimiser from which on it is hot, bytes of its windows in a bucket, and groups of tasks that are merged first.
HOT, _HOT_BUCKET, _SALTS = 1 << 22, 64_000_000, 256
_CODEC = pa.Codec("zstd", compression_level=3)
_OTHER = Rolling(101)
_HEAD = np.dtype([("id", "<i8"), ("tie", "<i8"), ("start", "<i4"), ("size", "<i4")])


def _zipped(raw: bytes) -> bytes:
    return _CODEC.compress(raw, asbytes=True)


def _window_hashes(words: Words, k: int):
    """Windows as (first word, text) with two independent hashes of their words' bytes."""
    a, b, text = words.windows(k)
    first = words.hashes(FIRST)
    return a, text, first, SECOND.spans(first, a, b), THIRD.spans(words.hashes(_OTHER), a, b)


def _later(h: np.ndarray, g: np.ndarray, ident: np.ndarray, tie: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows have an equal window at a smaller (id, tie, start)."""
    out = np.zeros(len(h), bool)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    some = order[twice]
    some = some[np.lexsort((start[some], tie[some], ident[some], g[some], h[some]))]
    new = np.ones(len(some), bool)
    new[1:] = (h[some[1:]] != h[some[:-1]]) | (g[some[1:]] != g[some[:-1]])
    first = some[np.flatnonzero(new)][np.cumsum(new) - 1] if len(some) else some
    out[some] = (ident[some] != ident[first]) | (tie[some] != tie[first]) | (start[some] != start[first])
    return out


def _spans(ident: np.ndarray, tie: np.ndarray, start: np.ndarray, k: int):
    """Word intervals covered by windows, joined where they touch within one document."""
    if not len(start):
        return ident, tie, start, start
    order = np.lexsort((start, tie, ident))
    ident, tie, start = ident[order], tie[order], start[order]
    new = np.ones(len(start), bool)
    new[1:] = (ident[1:] != ident[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] > start[:-1] + k)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1
    return ident[at], tie[at], start[at], start[last] + k


def _minimisers(words: Words, first: np.ndarray, a: np.ndarray, k: int) -> np.ndarray:
    """The smallest gram hash of each window, by doubling the span of a running minimum."""
    n = len(first)
    at = np.arange(n)
    low = THIRD.spans(first, at, np.minimum(at + _GRAM, n))
    span, need = 1, k - _GRAM + 1
    while span < need:
        step = min(span, need - span)
        low[: n - step] = np.minimum(low[: n - step], low[step:])
        span += step
    return low[a]


class _Blocks:
    """Packed super-k-mers of one task, by bucket, until there are enough to make large blocks of them."""

    def __init__(self):
        self.parts: dict[int, list] = {}
        self.size = 0

    def add(self, bucket: int, rows: np.ndarray, texts: bytes) -> None:
        self.parts.setdefault(bucket, []).append((rows, texts))
        self.size += len(texts) + rows.nbytes

    def flush(self):
        for bucket, parts in self.parts.items():
            rows = np.concatenate([r for r, _ in parts])
            body = rows.tobytes() + b"".join(t for _, t in parts)
            yield bucket, 0, np.array([len(rows), len(body)], "<i8").tobytes() + _zipped(body)
        self.__init__()


def _runs(low: np.ndarray, a: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Where a super-k-mer begins: windows that don't follow the one before or have another minimiser."""
    cut = np.ones(len(a), bool)
    cut[1:] = (a[1:] != a[:-1] + 1) | (text[1:] != text[:-1]) | (low[1:] != low[:-1])
    return np.flatnonzero(cut)


def _weigh(k: int):
    """One task's counts of windows by minimiser."""

    def run(batches):
        counts = np.zeros(sketch.SLOTS, np.uint32)
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                words = Words(*utf8(piece.column(0)))
                a, _, text = words.windows(k)
                if len(a):
                    low = _minimisers(words, words.hashes(FIRST), a, k)
                    at = _runs(low, a, text)
                    np.add.at(counts, sketch.slot(mix(low[at])), np.diff(np.append(at, len(a))).astype(np.uint32))
        if counts.any():
            yield pa.record_batch(list(sketch.packed(counts)), names=["part", "counts"])

    return run


_WINDOW = np.dtype([("h", "<u8"), ("g", "<u8"), ("id", "<i8"), ("tie", "<i8"), ("start", "<i4")])


def _hot_windows(k: int, buckets: int, is_hot):
    """Windows of hot minimisers, all but the earliest of equal ones of a piece left out, in blocks by their hash and the task's group."""

    def run(batches):
        hot, salt = is_hot(), TaskContext.get().partitionId() % _SALTS
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                ids, ties = np.asarray(piece.column(0)), np.asarray(piece.column(1))
                words = Words(*utf8(piece.column(2)))
                a, text, first, h, g = _window_hashes(words, k)
                if not len(a):
                    continue
                some = hot(_minimisers(words, first, a, k))
                a, text, h, g = a[some], text[some], h[some], g[some]
                rows = np.empty(len(a), _WINDOW)
                rows["h"], rows["g"], rows["id"], rows["tie"], rows["start"] = h, g, ids[text], ties[text], a - words.first[text]
                rows = rows[~_later(h, g, rows["id"], rows["tie"], rows["start"])]
                to = (mix(rows["h"]) % _U(buckets)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                rows, to = rows[order], to[order]
                edge = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
                if len(rows):
                    blocks = [len(rows[x:y]).to_bytes(8, "little") + _zipped(rows[x:y].tobytes()) for x, y in zip(edge[:-1], edge[1:])]
                    yield pa.record_batch([pa.array(to[edge[:-1]]), pa.array([salt] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "salt", "block"])

    return run


def _merge_windows(k: int, last: bool):
    """One bucket of hot windows: the marked intervals and, unless it is the ``last`` merge, a block of the earliest of each."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.concatenate([np.frombuffer(pa.decompress(x[8:], decompressed_size=_WINDOW.itemsize * int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True), _WINDOW) for x in pdf["block"]])
        later = _later(rows["h"], rows["g"], rows["id"], rows["tie"], rows["start"])
        gone = rows[later]
        out = pd.DataFrame(dict(zip(("id", "tie", "s", "e"), _spans(gone["id"], gone["tie"], gone["start"].astype(np.int64), k))), dtype="Int64")
        if last:
            return out
        rest = rows[~later]
        block = len(rest).to_bytes(8, "little") + _zipped(rest.tobytes())
        out = out.reindex(range(len(out) + 1))  # one row more, of nulls but for the block
        return out.assign(bucket=pdf["bucket"].iloc[0], block=[None] * (len(out) - 1) + [block])

    return run


def _travel(k: int, buckets: int, is_hot):
    """Blocks for the buckets: packed super-k-mers of minimisers that aren't hot, and intervals that this task has marked itself."""
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.binary())])
    record = lambda out: pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def run(batches):
        blocks, hot = _Blocks(), is_hot()
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                ids, ties = np.asarray(piece.column(0)), np.asarray(piece.column(1))
                words = Words(*utf8(piece.column(2)))
                a, text, first, h, g = _window_hashes(words, k)
                if not len(a):
                    continue
                start = (a - words.first[text]).astype(np.int64)
                later = _later(h, g, ids[text], ties[text], start)
                if later.any():
                    i, t, s, e = _spans(ids[text[later]], ties[text[later]], start[later], k)
                    rows = np.empty(len(i), _HEAD)
                    rows["id"], rows["tie"], rows["start"], rows["size"] = i, t, s, e - s
                    to = (mix(i.view(_U)) % _U(buckets)).astype(np.int32)
                    yield record([(int(b), 1, rows[to == b].tobytes()) for b in np.unique(to)])
                low = _minimisers(words, first, a, k)
                goes = ~(later | hot(low))
                low, a, text, start = low[goes], a[goes], text[goes], start[goes]
                if not len(a):
                    continue
                at = _runs(low, a, text)
                last = a[np.append(at[1:], len(a)) - 1] + k - 1
                to = (mix(low[at]) % _U(buckets)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                at, last, to = at[order], last[order], to[order]
                lo, hi = words.start[a[at]], words.end[last]
                rows = np.empty(len(at), _HEAD)
                rows["id"], rows["tie"], rows["start"], rows["size"] = ids[text[at]], ties[text[at]], start[at], hi - lo
                raw = memoryview(words.buf)
                edge = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
                for x, y in zip(edge[:-1], edge[1:]):
                    blocks.add(int(to[x]), rows[x:y], b"".join([raw[p:q] for p, q in zip(lo[x:y].tolist(), hi[x:y].tolist())]))
            if blocks.size > _HELD:
                yield from (record([b]) for b in blocks.flush())
        yield from (record([b]) for b in blocks.flush())
        trim()

    return run


def _count(k: int):
    """One bucket: windows of all packed strings, sorted; the marked intervals."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done = [np.frombuffer(x, _HEAD) for x in pdf["block"][pdf["kind"] == 1]]
        done = [(r["id"], r["tie"], r["start"].astype(np.int64), (r["start"] + r["size"]).astype(np.int64)) for r in done]
        parts = []
        for block in pdf["block"][pdf["kind"] == 0]:
            n, size = np.frombuffer(block[:16], "<i8")
            body = pa.decompress(block[16:], decompressed_size=int(size), codec="zstd", asbytes=True)
            rows, buf = np.frombuffer(body, _HEAD, int(n)), np.frombuffer(body, np.uint8, offset=int(n) * _HEAD.itemsize)
            off = np.concatenate([[0], np.cumsum(rows["size"], dtype=np.int64)])
            edge = [0, *(np.flatnonzero(np.diff(off[:-1] // (1 << 20))) + 1), len(rows)]
            for x, y in zip(edge[:-1], edge[1:]):
                words = Words(buf[off[x] : off[y]], off[x : y + 1] - off[x])
                a, text, _, h, g = _window_hashes(words, k)
                row = rows[x:y][text]
                parts.append((h, g, row["id"], row["tie"], row["start"] + (a - words.first[text])))
        if parts:
            h, g, ident, tie, start = (np.concatenate(c) for c in zip(*parts))
            later = _later(h, g, ident, tie, start)
            done.append(_spans(ident[later], tie[later], start[later], k))
        parts = h = g = ident = tie = start = None
        trim()
        cols = [np.concatenate(c) for c in zip(*done)] if done else [np.empty(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(("id", "tie", "s", "e"), cols)))

    return run


def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Words, removed words and what is left of each text."""
    n, gone, kept = [], [], []
    for raw, cuts in zip(text.cast(pa.large_binary()).to_pylist(), spans.to_pylist()):
        words = (raw or b"").split()
        n.append(len(words))
        if cuts:
            keep = np.ones(len(words), bool)
            for c in cuts:
                keep[c["s"] : c["e"]] = False
            words = [words[i] for i in np.flatnonzero(keep)]
        gone.append(n[-1] - len(words))
        kept.append(b" ".join(words))
    kept = pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), kept], names=["n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, hot: int = HOT) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_words``, ``n_removed`` and ``kept``, the remaining words joined by one space.

    A word is removed if a window of ``window`` words that covers it also starts earlier: in a document of smaller
    id, or earlier in the same document. Windows are judged on the input. Null, empty and blank texts have no words
    and an empty ``kept``; texts shorter than the window lose nothing. A null id counts as the smallest. Rows of one
    id and one text are one document, so repeated rows leave each other alone; rows of one id and different texts
    come in the order of a 64-bit hash of the text. Columns of ``docs`` with the names of the results are replaced.
    ``hot`` only decides which way windows travel.
    """
    scratch = Scratch(docs.sparkSession)
    key = {"_tf_id": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "_tf_tie": F.xxhash64(text_col)}
    docs = docs.withColumns(key)
    source = docs.select("_tf_id", "_tf_tie", F.col(text_col).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * least, size * 3 // _BUCKET + 1)
    levels = sketch.levels(scratch.write(source.select("text").mapInArrow(_weigh(window), "part int, counts binary"), narrow=False))
    hot_level = int(sketch.level_of(max(hot, 4 * size // 6 // sketch.SLOTS)))
    shared = docs.sparkSession.sparkContext.broadcast(levels.tobytes())

    def is_hot():
        table = np.frombuffer(shared.value, np.uint8)
        return lambda low: table[sketch.slot(mix(low))] >= hot_level

    packed = source.mapInArrow(_travel(window, buckets, is_hot), "bucket int, kind int, block binary")
    marked = packed.groupBy("bucket").applyInPandas(_count(window), "id long, tie long, s long, e long")
    if (levels >= hot_level).any():
        many = max(2 * least, size // 6 * _WINDOW.itemsize // _HOT_BUCKET + 1)
        windows = source.mapInArrow(_hot_windows(window, many, is_hot), "bucket int, salt int, block binary")
        once = scratch.write(windows.groupBy("bucket", "salt").applyInPandas(_merge_windows(window, False), "id long, tie long, s long, e long, bucket int, block binary"), narrow=False)
        twice = once.filter("block is not null").select("bucket", "block").groupBy("bucket").applyInPandas(_merge_windows(window, True), "id long, tie long, s long, e long")
        marked = marked.unionByName(once.filter("block is null").select("id", "tie", "s", "e")).unionByName(twice)
    marked = scratch.write(marked, narrow=False)
    scratch.keep(marked)
    spans = marked.groupBy(F.col("id").alias("_tf_id"), F.col("tie").alias("_tf_tie")).agg(F.collect_list(F.struct("s", "e")).alias("_tf_spans"))
    cut = F.arrow_udf(_cut, "n_words long, n_removed long, kept string")
    joined = docs.join(spans, ["_tf_id", "_tf_tie"], "left").withColumn("_tf_out", cut(F.col(text_col), F.col("_tf_spans")))
    out = {c: F.col(f"_tf_out.{c}") for c in ("n_words", "n_removed", "kept")}
    return joined.withColumns(out).drop("_tf_id", "_tf_tie", "_tf_spans", "_tf_out")
