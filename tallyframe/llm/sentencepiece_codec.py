"""Operator 1: SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here (pieces with scores and types, trainer and normaliser settings) and rebuilt as a
``tokenizers`` pipeline: character map (``CharMap``), white-space rules, the metaspace marker in place of spaces, unigram scores or
BPE merges in score order, and byte fallback. If no piece of the vocabulary has a marker after another character,
no token crosses a space, so a text falls apart into units of spaces and what follows them; each distinct unit is then
encoded once, in batches and on several threads, and its ids are reused. Every new unit is also encoded with the
original library, and a text whose units all agree has parity.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .pretokens import PieceBytes, PreTokens
from .words import FIRST, pieces, utf8

_SPACE = "▁"
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
_THREADS = 2


def _fields(raw: bytes):
    """(number, value) of each field of a protobuf message; varints as int, others as bytes."""
    at, n = 0, len(raw)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, raw[at : at + size]
            at += size


@dataclass
class Model:
    """What the file of a model says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    bpe: bool = False
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    extra_spaces_removed: bool = True

    @classmethod
    def load(cls, path: str) -> Model:
        out = cls()
        with open(path, "rb") as file:
            raw = file.read()
        for number, value in _fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                out.pieces.append((piece, score, kind))
            elif number == 2:
                for n, v in _fields(value):
                    if n == 3:
                        out.bpe = v == 2
                    elif n == 35:
                        out.byte_fallback = bool(v)
            elif number == 3:
                for n, v in _fields(value):
                    if n == 2:
                        out.charsmap = v
                    elif n == 3:
                        out.dummy_prefix = bool(v)
                    elif n == 4:
                        out.extra_spaces_removed = bool(v)
        return out

    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def units(self) -> bool:
        """Whether no token crosses from another character to a marker, and spaces are only replaced."""
        plain = all(_SPACE not in p.lstrip(_SPACE) for p, _, kind in self.pieces if kind in (NORMAL, USER))
        return plain and self.dummy_prefix and not self.charsmap and not self.extra_spaces_removed and not any(k == USER for _, _, k in self.pieces)

    def normaliser(self):
        """What follows the character map."""
        from tokenizers import Regex, normalizers as N

        steps = []
        if self.extra_spaces_removed:
            steps += [N.Replace(Regex(" {2,}"), " "), N.Replace(Regex(r"\A | \z"), "")]
        steps += [N.Prepend(_SPACE)] * self.dummy_prefix + [N.Replace(" ", _SPACE)]
        return N.Sequence(steps)

    def tokenizer(self, normalised: bool = False):
        """The pipeline; ``normalised``: for texts that are normalised already."""
        from tokenizers import AddedToken, Tokenizer, models

        vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        if self.bpe:
            usable = {p for p, _, kind in self.pieces if kind in (NORMAL, USER, UNUSED)}
            merges = []
            for i, (p, score, kind) in enumerate(self.pieces):
                if kind == NORMAL:
                    halves = [(p[:j], p[j:]) for j in range(1, len(p)) if p[:j] in usable and p[j:] in usable]
                    merges += [(-score, i, vocab[a], vocab[b], a, b) for a, b in halves]
            merges = [m[4:] for m in sorted(merges)]
            model = models.BPE(vocab, merges, unk_token=self.pieces[self.unknown()][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            model = models.Unigram([(p, score) for p, score, _ in self.pieces], self.unknown(), byte_fallback=self.byte_fallback)
        out = Tokenizer(model)
        if not normalised:
            out.normalizer = self.normaliser()
        users = [AddedToken(p, normalized=False) for p, _, kind in self.pieces if kind == USER]
        if users:
            out.add_tokens(users)
        return out

    def piece_bytes(self) -> list[bytes]:
        """What each id stands for when decoded."""
        table = []
        for p, _, kind in self.pieces:
            if kind == BYTE:
                table.append(bytes([int(p[3:5], 16)]))
            elif kind == UNKNOWN:
                table.append(" ⁇ ".encode())
            else:
                table.append(b"" if kind == CONTROL else p.replace(_SPACE, " ").encode())
        return table


class CharMap:
    """A model's character map: a double-array trie of UTF-8 keys with their replacements. At each place the longest key applies; user pieces stay as they are.

    The tokenizers library's own step takes the shortest key of a letter with combining marks, so that under case folding the marks are lost.
    """

    def __init__(self, raw: bytes, users: list[str]):
        size = int.from_bytes(raw[:4], "little")
        unit, texts, letters = np.frombuffer(raw, "<u4", size // 4, 4).astype(np.int64), raw[4 + size :], np.arange(1, 256)
        base = lambda at: at ^ int(unit[at] >> 10 << ((unit[at] & 512) >> 6))
        self.to, todo = {}, [(b"", base(0))]
        while todo:
            key, at = todo.pop()
            child = at ^ letters
            inside = child < len(unit)
            for c in letters[inside][(unit[child[inside]] & 0x800000FF) == letters[inside]].tolist():
                below = base(at ^ c)
                if unit[at ^ c] >> 8 & 1:
                    start = int(unit[below]) & 0x7FFFFFFF
                    self.to[(key + bytes([c])).decode()] = texts[start : texts.index(b"\0", start)].decode()
                todo.append((key + bytes([c]), below))
        self.starts: dict[str, list[str]] = {}
        for keys in (users, self.to):
            for k in sorted(keys, key=len, reverse=True):
                self.starts.setdefault(k[0], []).append(k)
        self.to |= {u: u for u in users}
        self.first = re.compile("[" + "".join(map(re.escape, self.starts)) + "]") if self.starts else None

    def apply(self, text: str) -> str:
        out, done = [], 0
        for m in self.first.finditer(text) if self.first else ():
            at = m.start()
            if at >= done and (key := next((k for k in self.starts[m[0]] if text.startswith(k, at)), None)) is not None:
                out += [text[done:at], self.to[key]]
                done = at + len(key)
        return "".join([*out, text[done:]])


class Codec(PreTokens):
    """Encodes and decodes batches; keeps the ids of distinct units between batches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.model = Model.load(path)
        self.by_unit = self.model.units()
        self.tokenizer = self.model.tokenizer(normalised=self.by_unit)
        self.whole = self.model.tokenizer()
        self.charmap = CharMap(self.model.charsmap, [p for p, _, kind in self.model.pieces if kind == USER]) if self.model.charsmap else None
        self.original = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = PieceBytes(self.model.piece_bytes())
        self.differ: set[int] = set()
        self._forget()

    def _forget(self) -> None:
        super()._forget()
        self.differ = set()

    @staticmethod
    def _threaded(encode, texts: list[str]) -> list[list[int]]:
        parts = [texts[lo : lo + 2048] for lo in range(0, len(texts), 2048)]
        with ThreadPoolExecutor(_THREADS) as pool:
            return [ids for part in pool.map(encode, parts) for ids in part]

    def _encode(self, texts: list[str], tokenizer=None) -> list[list[int]]:
        tokenizer = tokenizer or self.tokenizer
        return self._threaded(lambda part: [x.ids for x in tokenizer.encode_batch_fast(part, add_special_tokens=False)], texts)

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after the other, the number of ids of each text and whether it has parity."""
        column = column.cast(pa.large_string()).fill_null("")
        if self.by_unit:
            marked = pc.match_substring(column, _SPACE).to_numpy(zero_copy_only=False)
        else:
            marked = np.ones(len(column), bool)
        plain = column.filter(pa.array(~marked))
        flat, count, same = self._units(plain)
        if not marked.any():
            return flat, count, same
        texts = column.filter(pa.array(marked)).to_pylist()
        ids = self._encode([self.charmap.apply(x) for x in texts] if self.charmap else texts, self.whole)
        others = [a == b for a, b in zip(ids, self.original.encode(texts, num_threads=_THREADS))]
        begin = np.concatenate([[0], np.cumsum(count)])
        each, sizes, equal = iter([flat[a:b] for a, b in zip(begin[:-1], begin[1:])]), [], np.zeros(len(column), bool)
        equal[~marked], equal[marked] = same, others
        rest = iter(ids)
        parts = [np.array(next(rest), np.uint32) if m else next(each) for m in marked]
        sizes = np.array([len(x) for x in parts], np.int64)
        return np.concatenate(parts) if parts else flat, sizes, equal

    def _units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(column)
        some = pc.greater(pc.binary_length(column), 0)
        buf, off = utf8(pc.if_else(some, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())), column))
        if not len(buf):
            return np.empty(0, np.uint32), np.zeros(n, np.int64), np.ones(n, bool)
        space = buf == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        start[off[:-1][np.diff(off) > 0]] = True
        lo = np.flatnonzero(start)
        hi = np.append(lo[1:], len(buf))
        text = np.searchsorted(off, lo, "right") - 1
        h, where, back = np.unique(FIRST.of_bytes(buf, lo, hi), return_index=True, return_inverse=True)
        slot, new = self._find(h)
        if new.any():
            raw = memoryview(buf)
            units = [str(raw[a:b], "utf-8") for a, b in zip(lo[where[new]].tolist(), hi[where[new]].tolist())]
            ids = self._encode([u.replace(" ", _SPACE) for u in units])
            theirs = self.original.encode([u[1:] for u in units], num_threads=_THREADS)
            theirs = [x if u != " " else [self.original.piece_to_id(_SPACE)] for x, u in zip(theirs, units)]
            self.differ.update(int(x) for x, a, b in zip(h[new], ids, theirs) if a != b)
            self._add(h[new], ids)
            slot = np.searchsorted(self.known, h)
        flat, size = self._gather(slot[back])
        count = np.bincount(text, weights=size, minlength=n).astype(np.int64)
        same = np.ones(n, bool)
        if self.differ:
            same[text[np.isin(h, np.array(list(self.differ), np.uint64))[back]]] = False
        return flat, count, same

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0]

    def decode_all(self, flat: np.ndarray, count: np.ndarray) -> list[str]:
        """The texts of ``count`` ids each: pieces joined, markers as spaces, bytes as UTF-8, without the marker put in front."""
        raw, at = self.bytes.gather(flat)
        raw, edge = raw.tobytes(), at[np.concatenate([[0], np.cumsum(count)])].tolist()
        out = []
        for a, b in zip(edge[:-1], edge[1:]):
            a += self.model.dummy_prefix and raw[a : a + 1] == b" " and b > a
            out.append(raw[a:b].decode("utf-8", "replace"))
        return out


@cache
def codec(path: str) -> Codec:
    """One for each worker process and file."""
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>, parity)`` for every row. A null or empty text has no ids; nothing is added to the ids."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            for piece in pieces(batch, text_col):
                flat, count, same = c.encode_all(piece.column(1))
                off = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                yield pa.record_batch([piece.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(flat.astype(np.int32))), pa.array(same)], names=[id_col, "ids", "parity"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(run, f"`{id_col}` long, ids array<int>, parity boolean")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, text)``: the text of every row's ids; null ids give an empty text."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            lists = batch.column(1)
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            texts = c.decode_all(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), count)
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(F.col(id_col), ids_col).mapInArrow(run, f"`{id_col}` long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row encoded and decoded again in one pass.

    ``(doc_id, n_tokens, ids_crc32, decoded_sha256, lossless, parity)``: the checksum is that of the ids as little-endian
    unsigned 32-bit numbers; ``lossless`` tells whether the decoded text is the text; null texts are empty.
    """
    small_batches(docs.sparkSession)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]

    def run(batches):
        c = codec(path)
        for batch in batches:
            for piece in pieces(batch, "text"):
                flat, count, same = c.encode_all(piece.column(1))
                end, rows = np.cumsum(count), []
                raw = memoryview(flat.astype("<u4").tobytes())
                for i, a, b, text, equal, back in zip(piece.column(0).to_pylist(), (end - count).tolist(), end.tolist(), piece.column(1), same.tolist(), c.decode_all(flat, count)):
                    rows.append((i, b - a, zlib.crc32(raw[4 * a : 4 * b]), hashlib.sha256(back.encode()).hexdigest(), back == (text.as_py() or ""), equal))
                if rows:
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless", "parity"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean, parity boolean")
