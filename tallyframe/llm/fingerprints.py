"""Operator 2: document fingerprints by one-permutation MinHash.

Every shingle of a document is hashed once; the top bits of the hash choose a bin and each bin keeps its smallest
hash. An empty bin takes the value of a non-empty one that a universal hash of its number and the attempt points to
(optimal densification). Of every bin the low ``BITS`` bits are stored, packed and written as hex. Two documents'
likeness is the share of equal bins, corrected for bins that agree by chance: ``(m - c) / (1 - c)`` with
``c = 2**-BITS``, kept within 0 and 1.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, sampled, small_batches
from .words import FIRST, SECOND, Words, mix, utf8

BINS, BITS, WORDS = 512, 4, 5
_U = np.uint64
_SHIFT = _U(64 - BINS.bit_length() + 1)
_EMPTY = _U(2**64 - 1)
_TRIES = 256
#: Bytes of text in a range, and rows of the sample that ranges are cut at.
_RANGE, _SAMPLE = 16_000_000, 1_000_000


def minhash_bins(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stored bits of each bin of each text, and which texts have words."""
    words = Words(buf, off, lower=True)
    a, b, text = words.windows(WORDS, short=True)
    h = SECOND.spans(words.hashes(FIRST), a, b)
    n = len(off) - 1
    low = np.full(n * BINS, _EMPTY)
    np.minimum.at(low, text * BINS + (h >> _SHIFT).astype(np.int64), h)
    low = low.reshape(n, BINS)
    full = low != _EMPTY
    some = words.count > 0
    row, at = np.nonzero(~full & some[:, None])
    for t in range(_TRIES):
        if not len(row):
            break
        to = (mix(at.astype(_U) * _U(_TRIES) + _U(t)) % _U(BINS)).astype(np.int64)
        hit = full[row, to]
        low[row[hit], at[hit]] = low[row[hit], to[hit]]
        row, at = row[~hit], at[~hit]
    if len(row):  # few shingles: on from the last place to the next full bin, around the end
        to = (mix(at.astype(_U) * _U(_TRIES) + _U(_TRIES)) % _U(BINS)).astype(np.int64)
        for i in np.unique(row):
            bins = np.flatnonzero(full[i])
            here = row == i
            low[i, at[here]] = low[i, bins[np.searchsorted(bins, to[here]) % len(bins)]]
    # mixed with the bin's number, so that bins which hold copies of one value agree by chance each on their own
    return (mix(low + np.arange(BINS, dtype=_U) * _U(0x9E3779B97F4A7C15)) & _U(2**BITS - 1)).astype(np.uint8), some


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    """Of two rows of bins each; a text without words is like another such text (1) and like no other (0)."""
    chance = 2.0**-BITS
    share = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, share, (some_a == some_b).astype(float))


def packed_hex(bins: np.ndarray, some: np.ndarray) -> list[str]:
    """Two bins a byte, as hex; empty for a text without words."""
    raw = bins[:, ::2] << 4 | bins[:, 1::2]
    return [x.tobytes().hex() if s else "" for x, s in zip(raw, some)]


def fingerprint(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return minhash_bins(*utf8(pa.array(texts, pa.large_string())))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fingerprint)`` for every row: the plain form, without any shuffle. Null and wordless texts have an empty one."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.record_batch([part.column(0), pa.array(packed_hex(*minhash_bins(*utf8(part.column(1)))), pa.string())], names=[id_col, "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"`{id_col}` long, fingerprint string")


def _pairs(batches):
    """Rows of a partition come by bucket and in order; each is edited with the head of the one after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def finish(rows):
        """All rows but the last, which may still wait for its next."""
        texts = [r[3] for r in rows]
        bins, some = fingerprint(texts)
        own = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i + 1][0] == rows[i][0]]
        if not own:
            return None
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in own]
        other, other_some = fingerprint(edited)
        own, after = np.array(own), np.array(own) + 1
        columns = [
            [rows[i][2] for i in own],
            [len(texts[i]) for i in own],
            [hashlib.sha256(x.encode()).hexdigest() for x in edited],
            packed_hex(bins[own], some[own]),
            packed_hex(other, other_some),
            likeness(bins[own], some[own], other, other_some),
            likeness(bins[own], some[own], bins[after], some[after]),
        ]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
            text = row[3].as_py() or ""
            rows.append((*row[:3], text))
            size += len(text)
            if len(rows) > 512 or size > 1_000_000 and len(rows) > 1:
                if (out := finish(rows)) is not None:
                    yield out
                rows, size = rows[-1:], len(text)
    if len(rows) > 1 and (out := finish(rows)) is not None:
        yield out


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they and the next text are.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Documents follow by
    descending id, rows of one id by a hash of the text, and the first follows the last; the edited text has the last
    half (rounded down) of a text's code points replaced by as many first ones of the next text, or all it has. A null
    text is empty; a null id counts as the smallest and is returned as null. A single row is its own next.

    Documents in that order are cut into ranges of about ``_RANGE`` bytes at documents of a bounded sample; a range starts with the
    document of its cut, which is also dealt to the end of the range before. So one shuffle brings every text to its next
    one. Rows equal in id and text are in one range.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    total = source.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"), F.min(F.struct(-F.col("id").cast("decimal(20,0)"), F.col("tie"))).alias("first")).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total["bytes"] or 0) // _RANGE + 1)
    # only where ranges begin depends on this sample, not what is in the result
    some = source.filter(sampled(F.xxhash64(F.lit(3), "id", "tie"), min(40 * parts, _SAMPLE), total["rows"]))
    keys = sorted((-r["id"], r["tie"], r["bytes"]) for r in some.groupBy("id", "tie").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("bytes")).collect())
    share, reached, edges = sum(k[2] for k in keys) / parts, 0, [(int(total["first"][0]), total["first"][1])] if total["first"] else []
    for negative, tie, size in keys:
        if reached >= share and (negative, tie) > edges[-1]:
            edges.append((negative, tie))
            reached = 0
        reached += size
    shared = docs.sparkSession.sparkContext.broadcast(edges)

    def ranges(ident: pa.Array, tie: pa.Array) -> pa.Array:
        """The range of a document and, for the first of a range, that where it is a guest; two values each, -1 for none."""
        cuts, out = shared.value, []
        for key in zip((-x for x in ident.to_pylist()), tie.to_pylist()):
            at = bisect_right(cuts, key) - 1
            out += [at, (at - 1) % len(cuts) if cuts[at] == key else -1]
        return pa.FixedSizeListArray.from_arrays(pa.array(out, pa.int64()), 2).cast(pa.list_(pa.int64()))

    dealt = source.withColumn("ranges", F.arrow_udf(ranges, "array<long>")("id", "tie")).select("id", "text", "tie", F.posexplode("ranges").alias("guest", "range")).filter("range >= 0")
    dealt = dealt.withColumn("guest", F.col("guest") > 0).repartitionById(max(len(edges), 1), F.col("range").cast("int"))
    ordered = dealt.sortWithinPartitions("range", "guest", F.desc("id"), "tie").select("range", "guest", "id", "text")
    out = ordered.mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
