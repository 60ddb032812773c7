"""Operator 5: language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A trigram binds three of them, each permuted by its place
(a rotation of the vector), by multiplication; a text bundles the vectors of all its trigrams by addition, and a
language's prototype bundles its texts. A document gets the language whose prototype has the largest cosine with
the document's vector.

Vectors are made for the trigrams of a batch only and bundling is one matrix product of trigram counts with them.
Prototypes are learnt on a bounded, documented sample of the labelled rows (``sample_rows``): tasks bundle their
rows first, so that one vector for each task and language moves. All rows are then predicted.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled, small_batches

SAMPLE_ROWS = 40_000
_SYMBOLS = 64


@cache
def _symbol_of() -> np.ndarray:
    """Code point to symbol: 0 anything but a letter, 1-26 a-z, 27-63 other letters by a hash."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()[0]
            table[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + zlib.crc32(low.encode("utf-8", "surrogatepass")) % 37
    return table


@cache
def _letters(dims: int) -> np.ndarray:
    return np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (_SYMBOLS, dims))


def _bind(grams: np.ndarray, dims: int) -> np.ndarray:
    v = _letters(dims)
    return (np.roll(v, 2, 1)[grams >> 12] * np.roll(v, 1, 1)[grams >> 6 & 63] * v[grams & 63]).astype(np.float32)


def bundle(texts: list[str | None], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each text and its number of trigrams; runs of anything but letters count as one space."""
    points = [np.frombuffer(f" {x or ''} ".encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]
    size = np.array([len(x) for x in points])
    doc = np.repeat(np.arange(len(texts)), size)
    symbol = _symbol_of()[np.concatenate(points)].astype(np.int32)
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] > 0) | (symbol[:-1] > 0) | (doc[1:] != doc[:-1])
    symbol, doc = symbol[keep], doc[keep]
    gram = symbol[:-2] << 12 | symbol[1:-1] << 6 | symbol[2:]
    inside = (doc[:-2] == doc[2:]) & (symbol[1:-1] > 0)
    gram, doc = gram[inside], doc[:-2][inside]
    seen = np.zeros(_SYMBOLS**3, np.int32)
    seen[gram] = 1
    grams = np.flatnonzero(seen)
    seen[grams] = np.arange(len(grams))
    n = np.bincount(doc, minlength=len(texts))
    out = np.zeros((len(texts), dims), np.float32)
    if len(grams):
        rows = max(1, 4_000_000 // len(grams))
        vectors = _bind(grams, dims)
        for lo in range(0, len(texts), rows):
            a, b = np.searchsorted(doc, [lo, lo + rows])
            here = min(rows, len(texts) - lo)
            counts = np.bincount((doc[a:b] - lo) * len(grams) + seen[gram[a:b]], minlength=here * len(grams))
            out[lo : lo + rows] = counts.reshape(here, -1).astype(np.float32) @ vectors
    return out, n


def _slices(column: pa.Array, rows: int = 256, limit: int = 2_000_000):
    """Python texts in lists of bounded size."""
    part, size = [], 0
    for x in column:
        x = x.as_py()
        part.append(x)
        size += len(x or "")
        if len(part) >= rows or size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def learn(labelled: DataFrame, text_col: str, label_col: str, dims: int = 512) -> tuple[list[str], np.ndarray]:
    """Labels in order and their unit prototypes, from all rows given; every text weighs alike."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            labels, done = batch.column(1).to_pylist(), 0
            for texts in _slices(batch.column(0)):
                v, n = bundle(texts, dims)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                here = np.array(labels[done : done + len(texts)])
                done += len(texts)
                for label in set(here.tolist()):
                    total[label] = total.get(label, 0) + v[(here == label) & (n > 0)].sum(0, dtype=np.float64)
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array([np.rint(v * 2**20).tolist() for v in total.values()], pa.list_(pa.float64()))], names=["label", "vector"])

    parts = labelled.select(text_col, label_col).mapInArrow(run, "label string, vector array<double>")
    each = parts.select("label", F.posexplode("vector").alias("dim", "x")).groupBy("label", "dim").agg(F.sum("x").alias("x"))
    total: dict[str, np.ndarray] = {}
    for r in each.collect():  # labels x dims numbers
        total.setdefault(r["label"], np.zeros(dims))[r["dim"]] = r["x"]
    labels = sorted(total)
    vectors = np.array([total[x] / max(np.linalg.norm(total[x]), 1e-9) for x in labels]).reshape(len(labels), dims)
    return labels, vectors


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 if isinstance(id_col, str) else F.crc32(id_col.cast("string").cast("binary")) % 5


def language_id(docs: DataFrame, train: DataFrame, text_col: str = "text", label_col: str = "lang", dims: int = 512, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` with ``lang_pred`` and ``score``, predicted from the text alone.

    ``train`` has labelled rows (null labels and null texts are left out); if there are more than ``sample_rows``,
    about so many are taken by a hash of the text; copies count once. ``score`` is the cosine with the winning prototype, at least 0;
    equal cosines go to the label first in order. A text that is null or has no letter gets ``und`` and 0, as do
    all texts if nothing was learnt. Columns of ``docs`` with the names of the results are replaced.
    """
    small_batches(docs.sparkSession)
    train = train.select(F.col(text_col).alias("text"), F.col(label_col).alias("label")).filter("text is not null and label is not null")
    train = train.filter(sampled(F.xxhash64("text"), sample_rows, train.count())).dropDuplicates(["text", "label"])
    labels, vectors = learn(train, "text", "label", dims)
    to = vectors.T.astype(np.float32)

    def predict(text: pa.Array) -> pa.Array:
        names, scores = [], []
        for texts in _slices(text):
            v, n = bundle(texts, dims)
            if labels:
                cos = (v @ to) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                best = cos.argmax(1)
                known = n > 0
                names += [labels[b] if k else "und" for b, k in zip(best, known)]
                scores += np.where(known, np.clip(cos[np.arange(len(best)), best], 0, 1), 0).astype(float).tolist()
            else:
                names += ["und"] * len(texts)
                scores += [0.0] * len(texts)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    guess = F.arrow_udf(predict, "lang_pred string, score double")
    out = docs.withColumn("_tf_guess", guess(F.col(text_col)))
    return out.withColumns({c: F.col(f"_tf_guess.{c}") for c in ("lang_pred", "score")}).drop("_tf_guess")


def language_fold(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``(id_col, held_out, lang_pred, score)``: learnt on rows outside the held-out fold, predicted for all. A null id is held out."""
    held = F.coalesce(fold(id_col) == 0, F.lit(True))
    out = language_id(docs.select(id_col, text_col), docs.filter(~held), text_col, label_col)
    return out.select(id_col, held.alias("held_out"), "lang_pred", "score")


__all__ = ["SAMPLE_ROWS", "bundle", "fold", "language_fold", "language_id", "learn"]
