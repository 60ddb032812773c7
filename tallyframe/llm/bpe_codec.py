"""Operator 13: byte-level BPE encoding and decoding with contiguous rank arrays.

A word (pre-token) is a row of part ids with the merge ranks of adjacent parts beside it. The leftmost smallest rank is found
by a scan, the boundary there is deleted, both rows close up by one place, and the ranks left and right of the new part are
looked up again; a word without a mergeable pair is done. All words of one length take each step together as one
matrix, from the longest down: a step shortens a word by exactly one part, so words join those of the next length.

Scanning costs the square of a word's length, so words of more than ``SHORT`` bytes (rows of dashes, texts without
spaces) take the same merges from a heap over linked parts. Distinct words are encoded once and kept; texts are split into
words as in ``pretokens``, and those with unsettled characters or special tokens with the tokenizer's own splitter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .pretokens import _UNSURE, PieceBytes, PreTokens, byte_pieces, classes
from .words import pieces, utf8

#: Words of more bytes are merged with a heap.
SHORT = 128
_NONE = np.iinfo(np.int32).max


class RankArrays:
    """The merges of a tokenizer's file and the encoding of words with them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain byte-level BPE is supported")
        ids, pieces_of = model["vocab"], byte_pieces(path)
        self.of_byte = np.zeros(256, np.int64)
        single = np.flatnonzero(pieces_of.size == 1)
        self.of_byte[pieces_of.flat[pieces_of.start[single]]] = single
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        key = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        self.order = np.argsort(key).astype(np.int32)
        self.key = key[self.order]
        self.rank_of = {k: i for i, k in enumerate(key.tolist())}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of every pair of ids, or ``_NONE``."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.order[at], _NONE)

    def short(self, buf: np.ndarray, lo: np.ndarray, size: np.ndarray, put) -> None:
        """Encodes words of 1 to ``SHORT`` bytes; ``put(words, ids)`` gets rows of equally many ids."""
        begin = np.argsort(size, kind="stable")
        edge = np.searchsorted(size[begin], np.arange(SHORT + 2))
        n = int(size.max(initial=0))
        word, ids, rank = np.empty(0, np.int64), np.empty((0, n), np.int64), np.empty((0, max(n - 1, 0)), np.int32)
        for n in range(n, 0, -1):
            fresh = begin[edge[n] : edge[n + 1]]
            if len(fresh):
                own = self.of_byte[buf[lo[fresh][:, None] + np.arange(n)]]
                word, ids = np.concatenate([word, fresh]), np.concatenate([ids, own])
                rank = np.concatenate([rank, self.ranks(own[:, :-1], own[:, 1:]).astype(np.int32)])
            if not len(word):
                ids, rank = np.empty((0, n - 1), np.int64), np.empty((0, max(n - 2, 0)), np.int32)
                continue
            if n == 1:
                put(word, ids)
                return
            at = rank.argmin(1)
            best = rank[np.arange(len(word)), at]
            done = best == _NONE
            if done.any():
                put(word[done], ids[done])
                word, ids, rank, at, best = word[~done], ids[~done], rank[~done], at[~done], best[~done]
            row = np.arange(len(word))
            ids[row, at] = self.merged[best]
            keep = np.ones(ids.shape, bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(len(word), n - 1)
            keep = np.ones(rank.shape, bool)
            keep[row, at] = False
            rank = rank[keep].reshape(len(word), n - 2)
            for near, some in ((at - 1, at > 0), (at, at < n - 2)):
                r, c = row[some], near[some]
                rank[r, c] = self.ranks(ids[r, c], ids[r, c + 1])

    def long(self, raw: bytes) -> list[int]:
        """The same merges for one long word; pairs that have changed since they were put on the heap are passed over."""
        n = len(raw)
        ids = array("q", self.of_byte[np.frombuffer(raw, np.uint8)].tolist())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        rank = lambda i: self.rank_of.get(ids[i] << 32 | ids[after[i]]) if i >= 0 and after[i] < n else None
        heap = [r << 40 | i for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            r, i = top >> 40, top & (1 << 40) - 1
            if ids[i] < 0 or rank(i) != r:
                continue
            gone = after[i]
            ids[i], ids[gone], after[i] = int(self.merged[r]), -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            for j in (before[i], i):
                if (r := rank(j)) is not None:
                    heapq.heappush(heap, r << 40 | j)
        return [x for x in ids if x >= 0]

    def words(self, raws: list[bytes]) -> list[list[int]]:
        """Ids of every word."""
        out: list[list[int]] = [[] for _ in raws]
        size = np.array([len(r) for r in raws], np.int64)
        few = np.flatnonzero((size > 0) & (size <= SHORT))
        buf = np.frombuffer(b"".join([raws[i] for i in few.tolist()]), np.uint8)

        def put(words: np.ndarray, ids: np.ndarray) -> None:
            for i, x in zip(few[words].tolist(), ids.tolist()):
                out[i] = x

        if len(few):
            self.short(buf, np.cumsum(size[few]) - size[few], size[few], put)
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = self.long(raws[i])
        return out


class RankBpe(PreTokens):
    """``PreTokens`` whose words are encoded by rank arrays instead of the tokenizers library."""

    def __init__(self, path: str):
        super().__init__(path)
        self.arrays = RankArrays(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that take in what stands beside them are not supported")
        self.special_ids = {t.content: i for i, t in added.items()}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special_ids, key=len, reverse=True)) + ")") if added else None
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}

    def _split(self, text: str) -> list[bytes | int]:
        """Words and special ids of a text, by the tokenizer's own splitter."""
        out: list[bytes | int] = []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                out.append(self.special_ids[part])
            elif part:
                out += [bytes(self.byte_of[c] for c in word) for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def _encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of words, and of texts that ``PreTokens`` hands over whole, which are those with an unsettled character or a special token."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        end = np.cumsum([len(t) for t in texts])
        whole = set(np.searchsorted(end, np.flatnonzero(classes()[points] == _UNSURE), "right").tolist())
        whole |= {i for i, t in enumerate(texts) if any(s in t for s in self.special_ids)}
        split = {i: self._split(texts[i]) for i in whole}
        words = dict.fromkeys([t.encode() for i, t in enumerate(texts) if i not in whole] + [w for s in split.values() for w in s if not isinstance(w, int)])
        ids = dict(zip(words, self.arrays.words(list(words))))
        return [[y for w in split[i] for y in ([w] if isinstance(w, int) else ids[w])] if i in whole else ids[t.encode()] for i, t in enumerate(texts)]


@cache
def rank_bpe(path: str) -> RankBpe:
    """One for each worker process and file."""
    return RankBpe(path)


@cache
def _decimals(path: str) -> PieceBytes:
    """Every id as decimal digits and a comma."""
    return PieceBytes([b"%d," % i for i in range(len(byte_pieces(path).size))])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)``: the ids of every row's whole text; null and empty texts have none.

    ``path`` is the tokenizer's file, readable on every executor. Rows are independent: repeated rows and null ids are encoded as any other,
    and other columns are left out.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = rank_bpe(path)
        for batch in batches:
            for piece in pieces(batch, text_col):
                flat, count = bpe.encode(*utf8(piece.column(1)))
                off = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.record_batch([piece.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat.astype(np.int32)))], names=[id_col, "ids"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"`{id_col}` long, ids array<int>")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, text)``: the text of every row's ids, special ones included; null ids give an empty text.

    Bytes that are no UTF-8 become replacement characters, as where ids were cut within a character.
    """

    def run(batches):
        table = byte_pieces(path)
        for batch in batches:
            lists = batch.column(1)
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            raw, edge = table.gather(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            end = np.cumsum(count)
            texts = [raw[edge[a] : edge[b]].tobytes().decode("utf-8", "replace") for a, b in zip((end - count).tolist(), end.tolist())]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(F.col(id_col).cast("long").alias(id_col), ids_col).mapInArrow(run, f"`{id_col}` long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row encoded and decoded again in one pass: ``(doc_id, n_tokens, ids_sha256, decoded_sha256, lossless)``.

    ``ids_sha256`` is that of the decimal ids joined by commas; ``lossless`` tells whether the decoded text is the text. Edges as in ``encode``.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "lossless"]

    def run(batches):
        bpe, table, digits = rank_bpe(path), byte_pieces(path), _decimals(path)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            for piece in pieces(batch, "text"):
                buf, off = utf8(piece.column(1))
                flat, count = bpe.encode(buf, off)
                (said, said_at), (back, back_at) = digits.gather(flat), table.gather(flat)
                end, given = np.cumsum(count), memoryview(buf)
                rows = []
                for i, a, b, p, q in zip(piece.column(0).to_pylist(), (end - count).tolist(), end.tolist(), off[:-1].tolist(), off[1:].tolist()):
                    text = back[back_at[a] : back_at[b]].tobytes()
                    same = text == given[p:q]
                    decoded = text if same else text.decode("utf-8", "replace").encode()
                    rows.append((i, b - a, sha(said[said_at[a] : max(said_at[b] - 1, said_at[a])]), sha(decoded), same))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")
