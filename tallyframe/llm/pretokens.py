"""Byte-level BPE ids of many texts through their distinct pre-tokens.

The tokenizer's own split pattern (contractions; letters, digits or other signs with one leading space; white
space) is applied to whole batches with numpy; each distinct pre-token is then encoded once by the tokenizers
library and its ids are reused. Texts with characters whose Unicode class is not stable since Unicode 3.2, where
libraries may disagree, or with the tokenizer's special tokens are encoded whole by the library instead.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import cache

import numpy as np
import regex

from .words import FIRST

_SPACE, _LETTER, _NUMBER, _OTHER, _UNSURE = range(5)
_CACHE_WORDS = 1_000_000
#: The contractions of the split pattern after an apostrophe.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def classes() -> np.ndarray:
    """Class of every code point."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000))
    table = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
        table[[m.start() for m in regex.finditer(pattern, every)]] = kind
    old = unicodedata.ucd_3_2_0.category
    for c in range(0x80, 0x110000):
        x = chr(c)
        if old(x)[0] != unicodedata.category(x)[0] or old(x) in ("Cn", "Cs") or (c in (0x85, 0x180E, 0x200B, 0xFEFF)):
            table[c] = _UNSURE
    table[0x1C:0x20] = _UNSURE
    return table


def _starts(points: np.ndarray, cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point; ``first``: whether a text does."""
    n = len(points)
    before, after = np.full(n, 255, np.uint8), np.full(n, 255, np.uint8)
    before[1:], after[:-1] = cls[:-1], cls[1:]
    before[first] = 255
    after[:-1][first[1:]] = 255
    space = cls == _SPACE
    joins = np.zeros(n, bool)
    joins[1:] = points[:-1] == 32
    joins &= ~first
    start = np.where(space, (before != _SPACE) | ((after != _SPACE) & (after != 255)), (before != cls) & ~joins)
    start |= first
    mark = np.flatnonzero((points == 39) & start & (after == _LETTER))
    if len(mark):
        text = np.concatenate([points, [0, 0]])
        last = np.concatenate([first, [True, True]])
        for tail in _CONTRACTIONS:
            hit = mark[np.logical_and.reduce([(text[mark + 1 + i] == ord(c)) & ~last[mark + 1 + i] for i, c in enumerate(tail)])]
            start[hit + 1] = False
            end = hit + 1 + len(tail)
            start[end[end < n]] = True
    return start


class PreTokens:
    """Ids of texts; keeps the ids of up to ``_CACHE_WORDS`` distinct pre-tokens between batches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for lo in range(0, len(texts), 4096):
            out += [x.ids for x in self.tokenizer.encode_batch_fast(texts[lo : lo + 4096], add_special_tokens=False)]
        return out

    def _add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((y for x in ids for y in x), np.uint32, size.sum())
        at = np.cumsum(size) - size + len(self.ids)
        known = np.concatenate([self.known, h])
        order = np.argsort(known)
        self.known, self.at, self.size = known[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]
        self.ids = np.concatenate([self.ids, flat])

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known hashes and which are new; makes room for these."""
        slot = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        new = self.known[slot] != h if len(self.known) else np.ones(len(h), bool)
        if len(self.known) and len(self.known) + new.sum() > _CACHE_WORDS:
            self._forget()
            new = np.ones(len(h), bool)
        return slot, new

    def _gather(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids at these places one after the other, and how many each has."""
        at, size = self.at[slot], self.size[slot]
        return self.ids[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())], size

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other and the number of ids of each text; ``buf`` has the UTF-8 of all texts."""
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
        edge = np.searchsorted(lead, off)
        cls = classes()[points]
        first = np.zeros(len(points), bool)
        first[edge[:-1][edge[:-1] < edge[1:]]] = True
        start = np.flatnonzero(_starts(points, cls, first))
        lo = lead[start]
        hi = np.append(lo[1:], len(buf))
        text = np.searchsorted(off, lo, "right") - 1
        whole = np.searchsorted(edge, np.flatnonzero(cls == _UNSURE), "right") - 1
        raw_bytes = buf.tobytes()
        hits = [m.start() for s in self.special if s in raw_bytes for m in re.finditer(re.escape(s), raw_bytes)]
        whole = np.unique(np.concatenate([whole, np.searchsorted(off, hits, "right") - 1])).astype(np.int64)
        split = ~np.isin(text, whole)
        lo, hi, text = lo[split], hi[split], text[split]
        h, where, back = np.unique(FIRST.of_bytes(buf, lo, hi), return_index=True, return_inverse=True)
        slot, new = self._find(h)
        if new.any():
            raw = memoryview(buf)
            self._add(h[new], self._encode([str(raw[a:b], "utf-8") for a, b in zip(lo[where[new]].tolist(), hi[where[new]].tolist())]))
            slot = np.searchsorted(self.known, h)
        flat, size = self._gather(slot[back])
        count = np.bincount(text, weights=size, minlength=len(off) - 1).astype(np.int64)
        if len(whole):
            begin = np.concatenate([[0], np.cumsum(count)])
            each = [flat[a:b] for a, b in zip(begin[:-1], begin[1:])]
            for i, ids in zip(whole, self._encode([raw_bytes[off[i] : off[i + 1]].decode() for i in whole])):
                each[i] = np.array(ids, np.uint32)
            count = np.array([len(x) for x in each])
            flat = np.concatenate(each)
        return flat, count


class PieceBytes:
    """What each id stands for, as bytes, for decoding whole batches."""

    def __init__(self, table: list[bytes]):
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.size = np.array([len(x) for x in table], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def gather(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after the other and where each id's end, from 0 on."""
        size = self.size[ids]
        edge = np.concatenate([[0], np.cumsum(size)])
        return self.flat[np.repeat(self.start[ids] - edge[:-1], size) + np.arange(edge[-1])], edge


@cache
def byte_pieces(path: str) -> PieceBytes:
    """Those of a byte-level tokenizer: printable bytes stand for themselves, the others for characters from 256 on, in order."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    names = {i: name for name, i in tokenizer.get_vocab().items()}
    return PieceBytes([added[i] if i in added else bytes(byte_of[c] for c in names.get(i, "")) for i in range(max(names) + 1)])


@cache
def pre_tokens(path: str) -> PreTokens:
    """One for each worker process and file."""
    return PreTokens(path)
