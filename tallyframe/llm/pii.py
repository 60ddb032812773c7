"""Operator 7: information-theoretic sanitisation.

Formal patterns find protected entities (email, ip, card, phone). Co-occurrence over the whole corpus then tells
which other terms give an entity away: with ``N`` documents, entity ``e`` in ``n_e`` of them, term ``t`` in ``n_t``
and both anywhere in ``n_et``, the term reveals ``PMI = log2(N n_et / (n_e n_t))`` bits of the entity's
``IC = log2(N / n_e)``. A term that is seen with the entity in at least ``support`` different contexts (the words round the
entity where the term is among them, else those round the term; copies of one passage are one context) and whose PMI is at least ``disclosure`` of IC is a span too, in the documents that hold the
entity. Entities are generalised to their kind and revealing terms are removed in the sanitised text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, Scratch
from .words import FIRST, Words, pieces, utf8

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?()[]{}\"'"
#: Bits of the filter that keeps only words which may be candidate terms, and counts that a task gathers before it sends them.
_BITS, _GATHERED = 23, 1_000_000


def _luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(d * 2 - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def find_entities(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the formal patterns, each kind leftmost and without overlap, by start, end and kind.

    The scans are linear in the text, also for endless runs of digits or letters.
    """
    if not _ANY.search(text):
        return []
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            found.append((start, end, 0))
        at = text.find("@", at + 1)
    for chain in _CHAIN.finditer(text):
        if chain[0].count(".") >= 3:
            parts = list(_NUMBER.finditer(text, *chain.span()))
            for i in range(0, len(parts) - 3, 4):
                if all(len(x := p[0].lstrip("0")) < 4 and int(x or 0) <= 255 for p in parts[i : i + 4]):
                    found.append((parts[i].start(), parts[i + 3].end(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found)


def _hash(values: list[str]) -> np.ndarray:
    raw = [v.encode() for v in values]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return FIRST.of_bytes(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:]).view(np.int64)


def _contexts(near: int):
    """One row for each term near an entity: entity, term, hash of the context, document."""

    def run(batches):
        for batch in batches:
            ids, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = []
            for i, t, text in zip(ids, ties, batch.column(2)):
                text = text.as_py() or ""
                spans = find_entities(text)
                if not spans:
                    continue
                words = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
                starts = np.array([w[0] for w in words])
                covered = np.zeros(len(words), bool)
                reach = [(np.searchsorted(starts, s, "right") - 1, np.searchsorted(starts, e, "left")) for s, e, _ in spans]
                for a, b in reach:
                    covered[a:b] = True
                for (s, e, kind), (a, b) in zip(spans, reach):
                    around = [j for j in range(max(0, a - near), min(len(words), b + near)) if not covered[j]]
                    entity, context = f"{KINDS[kind]}:{text[s:e].lower()}", " ".join(words[j][2] for j in around)
                    terms = {x for j in around if (x := words[j][2].strip(_EDGE).lower())}
                    out += [(i, t, entity, x, context) for x in sorted(terms)] or [(i, t, entity, None, context)]
            if out:
                i, t, entity, term, context = zip(*out)
                hashed = lambda x: pa.array(_hash(list(x)))
                yield pa.record_batch([pa.array(i, pa.int64()), pa.array(t, pa.int64()), hashed(entity), pa.array(term, pa.string()), hashed(context)], names=["id", "tie", "entity", "term", "context"])

    return run


def _document_terms(near: int, slots: bytes):
    """One row for each distinct term of the documents with an entity in ``slots``: document, term, its hash and that of the words round it."""

    def run(batches):
        for batch in batches:
            for i, t, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                text = text.as_py() or ""
                spans = find_entities(text)
                if not spans or not _in_slots(slots, _hash([f"{KINDS[k]}:{text[s:e].lower()}" for s, e, k in spans])).any():
                    continue
                words = [(m.start(), m[0]) for m in _WORD.finditer(text)]
                starts = np.array([w[0] for w in words])
                covered = np.zeros(len(words), bool)
                for s, e, _ in spans:
                    covered[np.searchsorted(starts, s, "right") - 1 : np.searchsorted(starts, e, "left")] = True
                free, first = [w for (_, w), hidden in zip(words, covered) if not hidden], {}
                for j, w in enumerate(free):
                    if x := w.strip(_EDGE).lower():
                        first.setdefault(x, j)
                if first:
                    terms = list(first)
                    around = _hash([" ".join(free[max(0, j - near) : j + near + 1]) for j in first.values()])
                    yield pa.record_batch([pa.array([i.as_py()] * len(terms), pa.int64()), pa.array([t.as_py()] * len(terms), pa.int64()), pa.array(terms, pa.string()), pa.array(_hash(terms)), pa.array(around)], names=["id", "tie", "term", "h", "context"])

    return run


def _slots(hashes: DataFrame) -> bytes:
    """A bit for each of the filter's slots that the hashes ``h`` fall in."""
    at = F.shiftrightunsigned("h", 64 - _BITS) + 1
    bits = hashes.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("at"))
    slots = np.zeros((1 << _BITS) // 8, np.uint8)
    for r in bits.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")).collect():  # 2**_BITS bits in all
        slots[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return slots.tobytes()


def _in_slots(slots: bytes, h: np.ndarray) -> np.ndarray:
    at = (h.view(np.uint64) >> np.uint64(64 - _BITS)).astype(np.int64)
    return (np.frombuffer(slots, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _document_counts(slots: bytes):
    """How many documents of a task's texts hold each word that may be a candidate."""
    strip = np.zeros(256, bool)
    strip[[ord(c) for c in _EDGE]] = True

    def added(parts: list) -> tuple[np.ndarray, np.ndarray]:
        value, back = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        return value, np.bincount(back, np.concatenate([n for _, n in parts])).astype(np.int64)

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                folded = pa.array([(x or "").lower() for x in piece.column(0).to_pylist()], pa.large_string())
                words = Words(*utf8(folded), lower=False)
                raw, start, end = words.buf, words.start.copy(), words.end.copy()
                while len(start) and (more := (start < end) & strip[raw[np.minimum(start, len(raw) - 1)]]).any():
                    start += more
                while len(start) and (more := (start < end) & strip[raw[end - 1]]).any():
                    end -= more
                doc, keep = words.owner(), start < end
                h, doc = FIRST.of_bytes(raw, start[keep], end[keep]).view(np.int64), doc[keep]
                maybe = _in_slots(slots, h)
                h, doc = h[maybe], doc[maybe]
                if len(h):
                    order = np.lexsort((doc, h))
                    h, doc = h[order], doc[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                    parts.append(np.unique(h[new], return_counts=True))
                    size += len(parts[-1][0])
                    if size > _GATHERED:
                        parts = [added(parts)]
                        size = len(parts[0][0])
                        if size > _GATHERED // 2:
                            yield pa.record_batch(list(map(pa.array, parts[0])), names=["h", "n"])
                            parts, size = [], 0
        if parts:
            yield pa.record_batch(list(map(pa.array, added(parts))), names=["h", "n"])

    return run


def revealing_terms(source: DataFrame, scratch: Scratch, near: int, support: int, disclosure: float) -> DataFrame:
    """``(id, tie, terms)``: for documents that hold an entity, the terms which reveal it."""
    seen = scratch.write(source.mapInArrow(_contexts(near), "id long, tie long, entity long, term string, context long"))
    empty = seen.select("id", "tie", F.array("term").alias("terms")).limit(0)
    holds = scratch.write(seen.select("entity", "id", "tie").distinct())
    if holds.isEmpty():
        return empty
    total = source.count()
    entities = scratch.write(holds.groupBy("entity").agg(F.count("*").alias("n_e")))
    shared = entities.filter(F.col("n_e") >= min(2, support))  # in one document a distant term has one context only
    whole = scratch.write(source.mapInArrow(_document_terms(near, _slots(shared.select(F.col("entity").alias("h")))), "id long, tie long, term string, h long, context long"), narrow=False)
    hashed = F.arrow_udf(lambda x: pa.array(_hash(x.to_pylist())), "long")
    close = seen.filter("term is not null").select("entity", "term", "id", "tie", "context")
    # as n_et <= n_e, no term of more documents than this bound reaches the disclosure; n_w, its documents among those with an entity, is at most n_t
    bound = F.pow(F.lit(float(total)), F.lit(1 - disclosure)) * F.pow("n_e", F.lit(disclosure)) * (1 + 1e-9)
    least, most = min(2, support), entities.agg(F.max(bound)).first()[0]
    several = scratch.write(whole.groupBy("h").agg(F.count("*").alias("n_w")).filter(F.col("n_w").between(least, most)))
    held = holds.join(shared, "entity").withColumn("bound", bound)
    rare = whole.join(several, "h").join(held.groupBy("id", "tie").agg(F.max("bound").alias("most")), ["id", "tie"]).filter("n_w <= most")
    far = rare.join(held, ["id", "tie"]).filter("n_w <= bound").select("entity", "term", "id", "tie", "context")
    far = far.join(close.select("entity", "term", "id", "tie").distinct(), ["entity", "term", "id", "tie"], "left_anti")
    every = scratch.write(close.unionByName(far).distinct())
    contexts = every.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("contexts")).filter(F.col("contexts") >= support)
    contexts = scratch.write(contexts)
    if contexts.isEmpty():
        return empty
    joint = every.join(contexts.select("entity", "term"), ["entity", "term"], "left_semi").select("entity", "term", "id", "tie").distinct().groupBy("entity", "term").agg(F.count("*").alias("n_et"))
    joint = scratch.write(joint.withColumn("h", hashed("term")))
    # only terms with enough contexts of an entity are counted over all documents
    single = source.select("text").mapInArrow(_document_counts(_slots(joint.select("h"))), "h long, n long").groupBy("h").agg(F.sum("n").alias("n_t"))
    known = joint.join(single, "h", "left").join(entities, "entity")
    ic, pmi = F.log2(F.lit(float(total)) / F.col("n_e")), F.log2(F.lit(float(total)) * F.col("n_et") / (F.col("n_e") * F.greatest("n_t", "n_et")))
    bad = scratch.write(known.filter((ic > 0) & (pmi >= disclosure * ic)).select("entity", "term"))
    if bad.isEmpty():
        return empty
    out = scratch.write(holds.join(bad, "entity").groupBy("id", "tie").agg(F.sort_array(F.collect_set("term")).alias("terms")))
    scratch.keep(out)
    return out


def _mark(text: pa.Array, terms: pa.Array) -> pa.Array:
    rows = []
    for x, hidden in zip(text, terms.to_pylist()):
        x = x.as_py() or ""
        base = find_entities(x)
        spans = [(s, e, KINDS[k]) for s, e, k in base]
        extra = []
        if hidden and base:
            hidden, at_base, reached = set(hidden), 0, 0
            for m in _WORD.finditer(x):
                word = m[0].strip(_EDGE)
                at = m.start() + m[0].find(word)
                while at_base < len(base) and base[at_base][0] < at + len(word):
                    reached = max(reached, base[at_base][1])
                    at_base += 1
                if reached <= at and word.lower() in hidden:
                    extra.append((at, at + len(word), "term"))
        order = lambda s: (s[0], (*KINDS, "term").index(s[2]))
        spans, every = sorted(spans, key=order), sorted(spans + extra, key=order)
        n = [sum(k == i for _, _, k in base) for i in range(4)]
        join = lambda rows: ",".join(f"{k}:{s}:{e}" for s, e, k in rows)
        clean, at = [], 0
        for s, e, kind in every:
            if s >= at:
                clean += [x[at:s], f"[{kind.upper()}]" if kind != "term" else ""]
            at = max(at, e)
        rows.append((*n, join(spans), join(every), "".join([*clean, x[at:]]) if every else None))
    kinds = [pa.int64()] * 4 + [pa.string()] * 3
    names = [*(f"n_{k}" for k in KINDS), "base_spans", "spans", "sanitised"]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = 5, support: int = 3, disclosure: float = 0.8) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_email, n_ip, n_card, n_phone, base_spans, spans, sanitised``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind; ``spans`` adds the revealing
    terms as kind ``term``. ``sanitised`` has entities replaced by their kind in brackets and terms removed; a text
    without spans stays as it is. A null text has no spans and stays null. Rows of one id and one text are one document,
    so repeated rows do not count twice. Columns of ``docs`` with the names of the results are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.withColumns({"_tf_id": F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), "_tf_tie": F.xxhash64(text_col)})
    terms = revealing_terms(docs.select(F.col("_tf_id").alias("id"), F.col("_tf_tie").alias("tie"), F.col(text_col).alias("text")), scratch, near, support, disclosure)
    terms = terms.select(F.col("id").alias("_tf_id"), F.col("tie").alias("_tf_tie"), F.col("terms").alias("_tf_terms"))
    mark = F.arrow_udf(_mark, ", ".join([*(f"n_{k} long" for k in KINDS), "base_spans string", "spans string", "sanitised string"]))
    out = docs.join(terms, ["_tf_id", "_tf_tie"], "left").withColumn("_tf_out", mark(F.col(text_col), F.col("_tf_terms")))
    names = [*(f"n_{k}" for k in KINDS), "base_spans", "spans"]
    columns = {c: F.col(f"_tf_out.{c}") for c in names} | {"sanitised": F.coalesce(F.col("_tf_out.sanitised"), F.col(text_col))}
    return out.withColumns(columns).drop("_tf_id", "_tf_tie", "_tf_terms", "_tf_out")
